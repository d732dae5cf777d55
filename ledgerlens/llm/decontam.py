"""Benchmark decontamination: a broadcast hash set of n-grams, scanned over token windows.

Words are runs of digits, a-z and anything beyond ASCII, after lower-casing A-Z. Each
13 consecutive words of a benchmark item are a window; an item of fewer words is one
window as a whole. Words are 64-bit hashes, a window's hash is a sum of theirs, and the windows of each length are
a sorted array of hashes with the places they come from. Only where a
window's worth of words of the benchmark stands in a row is the set asked, and each hit is verified word by word at its places.

What is broadcast is bounded: a block has arrays of ``BLOCK_BYTES`` at most, and larger benchmarks (or items) are parted
into several. Each block finds its own windows in the whole texts, and what all of them found is judged and cut together.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, arrow_rows, fresh, small_batches, stored

WINDOW, PART = 13, 20
#: Bytes of a block's arrays: for each word 8 of its hash, 8 in the list of words, and 16 of the window that begins there; for each item some 100 of its name.
BLOCK_BYTES, WORD_BYTES, ITEM_BYTES = 64 << 20, 32, 100
_WORDS = bytes(ord(chr(c).lower()) if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Known(dict):
    """Hashes of words that the benchmark has, 0 for others; remembers at most ``most`` words."""

    def __init__(self, words: np.ndarray, most: int = 100_000):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = _word_hash(word)
        at = bisect_left(self.words, h)
        self[word] = found = h if at < len(self.words) and int(self.words[at]) == h else 0
        return found


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) or 1


def _sums(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of some items, as arrays."""

    def __init__(self, parts: list[tuple[str, np.ndarray, int]]):
        """Of parts of items: name, hashes of words, and length of its windows."""
        self.names = sorted({name for name, _, _ in parts})
        number = {name: i for i, name in enumerate(self.names)}
        self.words = np.concatenate([w for _, w, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.known = np.unique(self.words)
        starts = np.cumsum([0, *(len(w) for _, w, _ in parts)])
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {n for _, _, n in parts}:
            own = [(number[name], s, w) for (name, w, k), s in zip(parts, starts.tolist(), strict=False) if k == n]
            sums = np.concatenate([_sums(w, n) for _, _, w in own])
            place = np.concatenate([np.arange(s, s + len(w) - n + 1, dtype=np.int32) for _, s, w in own])
            item = np.concatenate([np.full(len(w) - n + 1, i, np.int32) for i, _, w in own])
            order = np.argsort(sums, kind="stable")
            self.sets[n] = sums[order], place[order], item[order]
        self._memo: Known | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": None}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, the windows found as (first word, length), and their items."""
        words = words_of(text)
        self._memo = self._memo or Known(self.known)
        ids = np.fromiter(map(self._memo.__getitem__, words), np.uint64, len(words))
        inside = np.concatenate([[0], np.cumsum(ids > 0)])
        spans, items = [], set()
        for n, (sums, places, numbers) in self.sets.items():
            if n > len(ids):
                continue
            at = np.flatnonzero(inside[n:] - inside[:-n] == n)
            if not len(at):
                continue
            near = ids[at[:, None] + np.arange(n)] if len(at) * n < 1 << 20 else None
            hashes = _sums(ids, n)[at]
            low, high = np.searchsorted(sums, hashes), np.searchsorted(sums, hashes, side="right")
            for k in np.flatnonzero(low < high).tolist():
                mine = near[k] if near is not None else ids[at[k] : at[k] + n]
                same = (self.words[places[low[k] : high[k], None] + np.arange(n)] == mine).all(axis=1)
                if same.any():
                    spans.append((int(at[k]), n))
                    items.update(self.names[i] for i in set(numbers[low[k] : high[k]][same].tolist()))
        return len(words), spans, items


def _parts(items: Iterable[tuple[str, str | None]], most: int) -> Iterator[list[tuple[str, np.ndarray, int]]]:
    """Parts of items for one block after the other; an item that doesn't fit is cut where its windows overlap."""
    room = max(2 * WINDOW, most // WORD_BYTES)
    held: list[tuple[str, np.ndarray, int]] = []
    left = room
    for name, text in items:
        words = np.fromiter(map(_word_hash, words_of(text)), np.uint64)
        n = min(WINDOW, len(words))
        at = 0
        while n:
            cost = -(-ITEM_BYTES // WORD_BYTES)
            if left < n + cost and held:
                yield held
                held, left = [], room
            take = words[at : at + max(n, left - cost)]
            held.append((name, take, n))
            left -= len(take) + cost
            at += len(take) - n + 1
            if at + n > len(words):
                break
    if held:
        yield held


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int) -> list:
    """Broadcast windows, block by block; items are read partition by partition, and one block is made at a time."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Windows(p)) for p in _parts(((r.item, r.text) for r in items.toLocalIterator()), block_bytes)] or [context.broadcast(Windows([]))]


def covered(spans: Iterable[tuple[int, int]], words: int) -> np.ndarray:
    hit = np.zeros(words, bool)
    for at, n in spans:
        hit[at : at + n] = True
    return hit


def contaminated(words: int, hits: int) -> bool:
    return hits > 0 and PART * hits >= words


_SPANS = "array<struct<first:int,words:int>>"


def _found(docs: DataFrame, row: str, text_col: str, windows, hits_only: bool) -> DataFrame:
    """(row, n_words, spans, items) for each row, or for those with hits."""
    kind = docs.select(F.col(row).alias("row")).dtypes[0][1]

    def run(rows: list, texts: list) -> dict[str, list]:
        new = [windows.value.scan(t) for t in texts]
        kept = [k for k, x in enumerate(new) if x[1] or not hits_only]
        return {
            "row": [rows[k] for k in kept],
            "n_words": [new[k][0] for k in kept],
            "spans": [[{"first": a, "words": n} for a, n in new[k][1]] for k in kept],
            "items": [sorted(new[k][2]) for k in kept],
        }

    return arrow_rows(docs.select(F.col(row).alias("row"), F.col(text_col).alias("text")), run, f"row {kind}, n_words bigint, spans {_SPANS}, items array<string>", rows=256)


def _all_found(keyed: DataFrame, row: str, text_col: str, blocks: list) -> DataFrame:
    """(row, n_words, spans, items) of all blocks, by the unique column ``row``; only the first block gives the rows without hits."""
    each = [_found(keyed, row, text_col, b, k > 0) for k, b in enumerate(blocks)]
    found = each[0]
    for more in each[1:]:
        found = found.union(more)
    return found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) for each row; spans are (first word, words), items ids as sorted strings.

    Null texts have no words. Items without words have no windows; a null item id is written ``null``.
    """
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    if len(blocks) == 1:
        return _found(docs, id_col, text_col, blocks[0], False).withColumnRenamed("row", "doc_id")
    keyed = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")), "benchmark-rows")
    return keyed.select("doc_id", "row").join(_all_found(keyed, "row", "text", blocks), "row").drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of documents (doc_id, text)."""

    def digest(ids: list, words: list, spans: list, items: list) -> dict[str, list]:
        hits = [int(covered([(s["first"], s["words"]) for s in x], n).sum()) for x, n in zip(spans, words, strict=True)]
        return {
            "doc_id": ids,
            "n_words": words,
            "n_hit": hits,
            "n_items": [len(x) for x in items],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": [contaminated(n, h) for n, h in zip(words, hits, strict=True)],
        }

    found = scan(docs, benchmark, block_bytes=block_bytes)
    return arrow_rows(found, digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def without_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words, nor what stands between two of them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join(kept) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns kept, without contaminated ``documents`` or, if ``how`` is ``spans``, without the words hit in any.

    The result doesn't depend on ``block_bytes``: with several blocks, all hits of a row are gathered before it is judged or cut.
    """
    blocks = _blocks(benchmark, item_col, item_text, block_bytes)
    one = blocks[0] if len(blocks) == 1 else None
    names, schema = docs.columns, docs.schema
    if one is not None:
        given = docs
    else:
        row, found_col = fresh("_row", docs), fresh("_found", docs)
        keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
        found = _all_found(keyed, row, text_col, blocks).select(F.col("row").alias(row), F.struct("n_words", "spans").alias(found_col))
        given = keyed.join(found, row).select(*names, found_col)
    small_batches(docs.sparkSession)
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                if one is not None:
                    hits = [covered(spans, n) for n, spans, _ in map(one.value.scan, texts)]
                else:
                    hits = [covered([(s["first"], s["words"]) for s in f["spans"]], f["n_words"]) for f in part.column(len(names)).to_pylist()]
                part = part.select(range(len(names)))
                if how == "documents":
                    yield part.filter(pa.array([not contaminated(len(h), int(h.sum())) for h in hits], pa.bool_()))
                else:
                    left = [without_spans(t, h) if h.any() else t for t, h in zip(texts, hits, strict=True)]
                    yield part.set_column(place, part.schema.field(place), pa.array(left, part.schema.field(place).type))

    return given.mapInArrow(run, schema)
