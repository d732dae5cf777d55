"""Cross-tokenizer alignment: token links of two tokenizers, scored by corpus-wide counts in id-striped matrices.

Tokenizer A is a byte-level BPE that gets a space and the text, tokenizer B a piece BPE that adds the space itself.
Byte offsets where tokens of both end cut a text into groups, and each A token of a group is linked with each B token of it.

1. Texts are cut before each lone space or line feed that has other characters than white space on both sides, and between a letter and a stop. No token of either
   vocabulary crosses such a place, so each unit is tokenized once, its groups and links are remembered, and a text's are those of its units in a row.
   A text with a unit whose tokens don't give its bytes back is judged again as a whole.
2. A batch of documents gives one row for each stripe of A ids (``id % STRIPES``): which pairs its documents hold, and how often. Only the rows of a batch are in
   memory at a time; they are written once and read by both of the following steps.
3. Counts of documents are added up for each batch's pairs, again for each task, and then stripe by stripe with ``np.add.at`` in a dense matrix
   of the stripe's A ids and all B ids. Its row maxima give each A id's best pairs. A matrix has the same size, whatever the corpus.
4. Links are dealt by lane (a set of stripes) and by batch, and a lane's counts go to each part of its links. A task streams them stripe by stripe, holding one stripe's
   matrix and the sums of some batches' documents. A document's sums are added up over the lanes.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, partitions, stored

#: Stripes of A ids, and sets of these that are scored together.
STRIPES, LANES = 3_142, 32
#: Bits of a B id in a pair; bytes of text and documents in a batch; units that a worker remembers; batches of a part of a lane's links; entries that a counting task holds.
B_BITS, BATCH_BYTES, BATCH_DOCS, REMEMBERED, LANE_BATCHES, HELD = 15, 4 << 20, 1 << 16, 500_000, 64, 1 << 22
#: Fixed value: how the plain byte-level pre-tokenizer parts texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens of both tokenizers, their groups and links, by way of units that were met before.

    ``most`` units are remembered; what a batch needs beyond that empties the table first.
    """

    #: Before a lone space or line feed, and between a letter and a stop.
    LETTER, STOP = r"[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,!?;:]"
    CUT = re.compile(rf"(?<=[^\s▁])(?=[ \n][^\s▁])|(?<={LETTER})(?={STOP})")
    #: Units that the faster encoder of A gets: here its classes of characters are beyond doubt.
    PLAIN = re.compile("[\n -~À-ɏ]+")

    def __init__(self, a_path: str, b_path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.most = Tokenizer.from_file(a_path), most
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 16:
            raise ValueError("vocabularies of more ids than a pair has room for")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # The cuts of texts rest on this: no piece has a space after another character, a line feed, or a letter beside a stop.
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p or re.search(self.LETTER + self.STOP, p) for p in plain)
        self.space, self.feed = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        self.fast = self._ranked(a_path, vocab)
        # Numbers with what follows them: a comma, a bar or a semicolon.
        self.numbers = [f"{i}{sign}" for sign in ",|;" for i in range(1 << 16)]
        self.digits = np.array([len(str(i)) for i in range(1 << 16)], np.int64)
        self._forget()

    def _ranked(self, a_path: str, vocab: dict[str, int]):
        """A faster encoder of the same vocabulary, if its merges are ranked by their ids and its pre-tokenizer is the plain byte-level one."""
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            given = json.load(file)
        merges = [m.split(" ") if isinstance(m, str) else m for m in given["model"].get("merges", [])]
        made = [vocab.get(x + y, -1) for x, y in merges]
        cutter = given.get("pre_tokenizer") or {}
        if given.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or made != sorted(set(made)) or -1 in made:
            return None
        ranked = {self.a_bytes[i]: i for i in {*made, *(i for i in vocab.values() if len(self.a_bytes[i]) == 1)}}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={})

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links; -1 first where bytes differ
        self.begins = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.uint32)

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids that each unit has within a text. A unit begins with the space or line feed before it, or with a stop."""
        a: list[list[int]] = [[]] * len(units)
        other = range(len(units))
        if self.fast is not None:
            match, encode, other = self.PLAIN.fullmatch, self.fast.encode_ordinary, []
            for k, u in enumerate(units):
                if match(u):
                    a[k] = encode(u)
                else:
                    other.append(k)
        for k, e in zip(other, self.a.encode_batch_fast([units[k] for k in other], add_special_tokens=False), strict=True):
            a[k] = e.ids
        spaced = [u[0] == " " for u in units]
        b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced, strict=True)], num_threads=1)
        return a, [ids if s else ids[2:] if ids[:2] == [self.space, self.feed] else [] for s, ids in zip(spaced, b, strict=True)]

    def learn(self, new: list[str]) -> None:
        said, sizes, links = [], [], []
        for at in range(0, len(new), 2_048):
            part = new[at : at + 2_048]
            found = self.aligned(part, *self.tokens(part))
            for column, more in zip((said, sizes, links), found, strict=True):
                column.append(more)
        base = len(self.said)
        self.known.update(zip(new, range(base, base + len(new)), strict=True))
        for more in said:
            self.said += more
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.links = np.concatenate([self.links, *links])
        self.begins = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]

    def aligned(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The groups of each unit as text, its sizes, and all links in a row."""
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        raw = [u.encode() for u in units]
        right = np.ones(len(units), bool)
        if not b"".join(raw) == b"".join([a_bytes[i] for ids in a for i in ids]) == b"".join([b_bytes[i] for ids in b for i in ids]):
            right = np.array([r == b"".join([a_bytes[i] for i in x]) == b"".join([b_bytes[i] for i in y]) for r, x, y in zip(raw, a, b, strict=True)], bool)
            a, b = ([ids if ok else [] for ids, ok in zip(side, right.tolist(), strict=True)] for side in (a, b))
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        left, below = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_sizes[left]), np.cumsum(self.b_sizes[below])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        times = in_b[group_a]
        stop = np.cumsum(times)
        start_b = np.cumsum(in_b) - in_b
        partner = np.repeat(start_b[group_a] - stop + times, times) + np.arange(int(times.sum()))
        links = (np.repeat(left, times) << B_BITS | below[partner]).astype(np.uint32)
        # All ids in the order of the text: each group's of A, then of B.
        place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids, key = np.concatenate([left, below])[place], np.sort(np.concatenate([2 * group_a, 2 * group_b + 1]))
        sign = np.full(len(ids), 2, np.int64)
        sign[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
        text = "".join(map(self.numbers.__getitem__, (sign << 16 | ids).tolist()))
        until = np.append(0, np.cumsum(self.digits[ids] + 1))[np.append(0, np.cumsum(n_a + n_b))].tolist()
        said = [text[s : e - 1] if e > s else "" for s, e in itertools.pairwise(until)]
        unit = np.repeat(np.arange(len(units)), n_a)
        groups = np.bincount(unit[np.searchsorted(end_a, ends)], minlength=len(units)) if len(ends) else np.zeros(len(units), np.int64)
        n_links = np.bincount(unit, weights=times, minlength=len(units)).astype(np.int64)
        return said, np.stack([np.where(right, n_a, -1), n_b, groups, n_links], axis=1), links

    def batch(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, int, str]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A tokens, B tokens, groups, links, groups as text) of each text, and the links: (pair, text number, times), sorted by these."""
        units = [self.CUT.split(" " + t) if t and self.cuts else [" " + t] if t else [] for t in texts]
        new = set().union(*units).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self._forget()
            new = set().union(*units)
        self.learn(list(new))
        get, rows, owner, chosen, times = self.known.__getitem__, [], [], [], []
        for k, own in enumerate(units):
            at = np.fromiter(map(get, own), np.int64, len(own))
            if len(own) > 1 and (self.sizes[at, 0] < 0).any():
                whole = " " + texts[k]
                if whole not in self.known:
                    self.learn([whole])
                at = np.array([get(whole)])
            if not len(at) or (self.sizes[at, 0] < 0).any():
                rows.append((0, 0, 0, 0, ""))
                continue
            rows.append((*self.sizes[at].sum(axis=0).tolist(), ";".join([self.said[i] for i in at.tolist()])))
            each, n = np.unique(at, return_counts=True)
            owner.append(np.full(len(each), k, np.int64))
            chosen.append(each)
            times.append(n)
        if not chosen:
            return rows, (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        owner, chosen, times = np.concatenate(owner), np.concatenate(chosen), np.concatenate(times)
        size = self.sizes[chosen, 3]
        ends = np.cumsum(size)
        links = self.links[np.repeat(self.begins[chosen] - ends + size, size) + np.arange(ends[-1])]
        code = links.astype(np.int64) << 32 | np.repeat(owner, size)
        weight = np.repeat(times, size)
        order = np.argsort(code, kind="stable")
        code, weight = code[order], weight[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        code, weight = code[first], np.add.reduceat(weight, first)
        return rows, ((code >> 32).astype(np.uint32), code & 0xFFFFFFFF, weight)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, each column by planes of bytes, compressed."""
    out = [np.array([len(columns)], "<u4").tobytes()]
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if not len(c) or int(c.max()) < 1 << 8 * w)
        out += [np.array([len(c), width], "<u4").tobytes(), np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()]
    return zstandard.compress(b"".join(out), 3)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    at, out = 4, []
    for _ in range(int(np.frombuffer(data, "<u4", 1)[0])):
        n, width = np.frombuffer(data, "<u4", 2, at).tolist()
        planes = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64))
        at += 8 + n * width
    return out


def _cell(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's stripe of A ids, and its cell in the stripe's matrix."""
    a = pair.astype(np.int64) >> B_BITS
    return a % STRIPES, a // STRIPES << B_BITS | pair.astype(np.int64) & (1 << B_BITS) - 1


def _deltas(sorted_numbers: np.ndarray) -> np.ndarray:
    return np.diff(sorted_numbers, prepend=0)


def _by_stripe(stripe: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The columns' parts for each stripe, in their order within it."""
    order = np.argsort(stripe, kind="stable")
    stripe, columns = stripe[order], [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(stripe) else stripe
    for b, e in zip(first.tolist(), [*first[1:].tolist(), len(stripe)], strict=False):
        yield int(stripe[b]), tuple(c[b:e] for c in columns)


def _link_rows(pair: np.ndarray, owner: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each stripe: its cells, how many documents hold each, and of each of these the number and the times."""
    stripe, cell = _cell(pair)
    for s, (c, o, t) in _by_stripe(stripe, cell, owner, times):
        new = np.append(True, c[1:] != c[:-1])
        first = np.flatnonzero(new)
        number = np.where(new, o, np.diff(o, prepend=0))  # within a cell, documents ascend
        yield s, _packed(_deltas(c[first]), np.diff(np.append(first, len(c))), number, t)


def _read_links(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells, documents of each, and for each cell's documents: number and times."""
    steps, held, number, times = _unpacked(blob)
    run = np.cumsum(number)
    first = np.cumsum(held) - held
    return np.cumsum(steps), held, run - np.repeat(run[first] - number[first], held), times


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Written once: a row of counts for each document (``stripe`` -1, ``doc`` its number in the ``batch``), and rows of links by batch and stripe.

    With ``keep_groups`` the groups of a document are there as text, in ``groups``.
    """
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    schema = f"batch bigint, stripe int, doc int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, links binary"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = (a_path, b_path)
        aligner = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))
        number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        texts: list[str | None] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, links = aligner.batch(texts)
            n = len(rows)
            nones = pa.nulls(n)
            columns = {
                "batch": pa.array([number] * n), "stripe": pa.array([-1] * n), "doc": pa.array(range(n)), "doc_id": pa.concat_arrays(ids),
                "groups_sha256": pa.array([hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "" for r in rows], pa.string()),
                "groups": pa.array([r[4] for r in rows], pa.string()) if keep_groups else nones, "links": nones,
            } | {c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
            found = list(_link_rows(*links))
            for at in range(0, len(found), 512):
                part = found[at : at + 512]
                columns = {"batch": pa.array([number] * len(part)), "stripe": pa.array([s for s, _ in part]), "links": pa.array([b for _, b in part], pa.binary())}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(part), f.type) for f in arrow], schema=arrow)

        for batch in batches:
            start = 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                texts.append(text)
                size += len(text or "")
                if size >= BATCH_BYTES or len(texts) >= BATCH_DOCS:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    yield from flush()
                    number, start, size = number + 1, k + 1, 0
                    ids.clear()
                    texts.clear()
            ids.append(batch.column(0).slice(start))
        if texts:
            yield from flush()

    return stored(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema), "aligned")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stripe, cells): the documents of each cell, added up over as many of a task's batches as ``HELD`` entries allow."""
    schema = pa.schema([("stripe", pa.int32()), ("cells", pa.binary())])
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        code, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return code[first], np.add.reduceat(n[order], first)

    def flush(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = [(s, _packed(_deltas(c), k)) for s, (c, k) in _by_stripe(code >> 32, code & 0xFFFFFFFF, n)]
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], schema=schema)

    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            cells, held, _, _ = _read_links(blob.as_py())
            codes.append(cells | s << 32)
            counts.append(held)
            size += len(cells)
            if size >= HELD:
                code, n = merged()
                codes, counts, size = [code], [n], len(code)
                if size >= HELD // 2:
                    yield flush(code, n)
                    codes, counts, size = [], [], 0
    if size:
        yield flush(*merged())


def _matrices(batches: Iterator[pa.RecordBatch], rows: int, columns: int) -> Iterator[pa.RecordBatch]:
    """(stripe, cells): all counts of a stripe, and which are their A id's highest. Rows come sorted by stripe; one dense matrix is held."""
    schema = pa.schema([("stripe", pa.int32()), ("cells", pa.binary())])
    dense, now = np.zeros((rows, 1 << B_BITS), np.int64), None

    def flush() -> pa.RecordBatch:
        best = dense[:, :columns].max(axis=1)
        cells = np.flatnonzero(dense)
        counts = dense.reshape(-1)[cells]
        blob = _packed(_deltas(cells), counts, counts == best[cells >> B_BITS])
        dense[:] = 0
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([blob], pa.binary())], schema=schema)

    for batch in batches:
        for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if now is not None and s != now:
                yield flush()
            now = s
            steps, counts = _unpacked(blob.as_py())
            np.add.at(dense.reshape(-1), np.cumsum(steps), counts)
    if now is not None:
        yield flush()


def counted(links: DataFrame, a_size: int = 50_257, b_size: int = 32_000) -> DataFrame:
    """(stripe, cells) of ``encoded`` rows: corpus-wide counts of documents, and the best of each A id."""
    spark = links.sparkSession
    rows = -(-max(a_size, 1) // STRIPES)
    added = links.where("stripe >= 0").select("stripe", "links").mapInArrow(_added, "stripe int, cells binary")
    dealt = added.repartition(min(partitions(spark), STRIPES), "stripe").sortWithinPartitions("stripe")
    return stored(dealt.mapInArrow(lambda batches: _matrices(batches, rows, b_size), "stripe int, cells binary"), "pair-counts")


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, docs, best) of ``counted``: how many documents hold the pair linked, and whether no pair of its A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                steps, n, best = _unpacked(blob.as_py())
                cells = np.cumsum(steps)
                columns = [pa.array(((cells >> B_BITS) * STRIPES + s).astype(np.int32)), pa.array((cells & (1 << B_BITS) - 1).astype(np.int32)), pa.array(n), pa.array(best == 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "docs", "best"])

    return counts.select("stripe", "cells").mapInArrow(run, "a int, b int, docs bigint, best boolean")


_SCORE = "batch bigint, doc int, n_best bigint, count_sum bigint"


def _scored(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The sums of each batch's documents over the stripes of a lane. Rows come sorted by (lane, part, stripe, batch), a stripe's counts first."""
    schema = pa.schema([("batch", pa.int64()), ("doc", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    counts, best = np.zeros(rows << B_BITS, np.int64), np.zeros(rows << B_BITS, bool)
    filled = np.zeros(0, np.int64)
    sums: dict[int, np.ndarray] = {}
    now = None

    def flush() -> Iterator[pa.RecordBatch]:
        for number, both in sums.items():
            doc = np.flatnonzero(both[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), number)), pa.array(doc.astype(np.int32)), pa.array(both[0][doc]), pa.array(both[1][doc])], schema=schema)
        sums.clear()

    for record in batches:
        lane, part, number, blobs = (record.column(k) for k in (0, 1, 3, 4))
        for where, k, blob in zip(zip(lane.to_pylist(), part.to_pylist(), strict=True), number.to_pylist(), blobs, strict=True):
            if where != now:
                yield from flush()
                now = where
            if k < 0:
                counts[filled], best[filled] = 0, False
                steps, n, top = _unpacked(blob.as_py())
                filled = np.cumsum(steps)
                counts[filled], best[filled] = n, top == 1
                continue
            cells, held, doc, times = _read_links(blob.as_py())
            most = int(doc.max()) + 1
            both = sums.get(k)
            if both is None or both.shape[1] < most:
                wide = np.zeros((2, most), np.int64)
                if both is not None:
                    wide[:, : both.shape[1]] = both
                both = sums[k] = wide
            np.add.at(both[0], doc, times * np.repeat(best[cells], held))
            np.add.at(both[1], doc, times * np.repeat(counts[cells], held))
    yield from flush()


def scored(links: DataFrame, counts: DataFrame, a_size: int = 50_257) -> DataFrame:
    """(batch, doc, n_best, count_sum) of the documents with links."""
    spark = links.sparkSession
    rows = -(-max(a_size, 1) // STRIPES)
    parts = max(1, -(-links.where("stripe = -1").select("batch").distinct().count() // LANE_BATCHES))
    lane = (F.col("stripe") % LANES).alias("lane")
    each = links.where("stripe >= 0").select(lane, F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int").alias("part"), "stripe", "batch", F.col("links").alias("cells"))
    told = counts.select(lane, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "stripe", F.lit(-1).cast("bigint").alias("batch"), "cells")
    dealt = each.unionByName(told).repartition(partitions(spark), "lane", "part").sortWithinPartitions("lane", "part", "stripe", "batch")
    return dealt.mapInArrow(lambda batches: _scored(batches, rows), _SCORE).groupBy("batch", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id, text), and ``groups`` if asked for.

    Null and empty texts, and those whose tokens of A or B don't give a space and the text back, have no tokens: zeros, and '' as hash and groups.
    Rows of one id, or with the same text, are documents of their own. A pair counts once for a document, however often it is linked there. An
    empty table gives no rows; other columns aren't read. A very long text is a batch by itself, whose memory is some times its size.
    """
    rows = encoded(docs, a_path, b_path, keep_groups=keep_groups)
    totals = scored(rows, counted(rows))
    each = rows.where("stripe = -1").join(totals, ["batch", "doc"], "left")
    none = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    return each.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256", *(["groups"] if keep_groups else []))
