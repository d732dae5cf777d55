"""Removal of repeated word passages by prefix-partitioned suffix trees.

A window is ``LENGTH`` consecutive words of one document. A word goes if it lies in a window whose words also start in a document with a smaller id.
The suffixes that begin with such windows meet in the suffix tree of all texts below one deep internal node, whose least document id decides.

1. Exact copies of a text become one, with the least id that has it. The texts left are written once, bucketed by their hash, so that what is found about
   them later comes to them without moving a text again.
2. Suffixes that share no window with others have no deep node above them; most are found without shuffling them. Equal windows hold
   the same least-hash gram of ``GRAM`` words at the same place, their anchor. Only anchors with a gram that several places have stay. The consecutive windows of an anchor are its context, and equal contexts become one.
3. A planning pass over all texts lists the prefixes that hold more than a share of all suffixes. Each suffix goes to the group of its first 4 words; if these are
   such a prefix, to that of its first 8, and then of its first 13. Groups that a task's stream can't be made to balance are thus split by longer prefixes, and where 13 words are
   still too many's, these are a deep node's whole path: its suffixes are salted, and the least ids of the parts are brought together.
4. A group's suffixes come sorted, as the leaves of its subtree. Those with a whole window in common lie below one deep node, and only its leaves are held at a time. What is removed
   needs no more than that node; ``repeats`` reads on below it, where the longest common prefixes of neighbours give the nodes by a stack.
5. Contexts get a mark for each window that is to go, documents their spans, and texts their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import FEW, HOT, _arrow_schema, bucketed, partitions, spread_join, stored

LENGTH, GRAM = 13, 5
#: Gram places of a window; lengths of the prefixes that suffixes are parted by; a prefix with more than this share of all suffixes is parted further.
PLACES, PREFIXES, SHARES = LENGTH - GRAM + 1, (4, 8, LENGTH), 20_000
#: Bytes of text that are hashed together, and of arrays of one step.
FLUSH, STEP = 1 << 21, 1 << 19
#: Bins of groups for each task of a shuffle.
BINS = 16
#: Bits of a text's second hash, which stand above an anchor's place: together with the first hash a text has 88 bits.
KEY_BITS, AT_BITS = 24, 40
_NO_ID = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\t-\r]")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = _mixed(np.arange(257, 257 + 4_096, dtype=np.uint64) * _ODD) | np.uint64(1)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes: sums of products of a byte's and its place's random number."""
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    inside = np.flatnonzero(word)
    place = inside - np.repeat(begin, size)
    value = _BYTE[data[inside]] * _PLACE[place & 4_095]
    if int(size.max()) > 4_096:
        value *= (place >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return begin, _mixed(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _ODD)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the number of words of each text."""
    raw = b" ".join(texts)
    begins, hashes, at = [], [], 0
    data = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        found = _SPACE.search(raw, min(at + STEP, len(raw)))
        until = found.start() if found else len(raw)
        begin, h = _hashed(data[at:until])
        begins.append(begin + at)
        hashes.append(h)
        at = until + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    sizes = np.diff(np.searchsorted(begin, ends), prepend=0)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), sizes


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = (out + h[k : k + len(out)]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def _prefixes(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first words, by ``PREFIXES``, of each ``LENGTH`` consecutive words, in one pass."""
    out, found = np.zeros(max(0, len(h) - LENGTH + 1), np.uint64), []
    for k in range(LENGTH):
        out += h[k : k + len(out)]
        out *= _ODD
        out ^= out >> np.uint64(31)
        if k + 1 in PREFIXES:
            found.append(out.copy())
    return found


def _window_starts(sizes: np.ndarray) -> np.ndarray:
    """The words that windows start with, counted over all texts."""
    room = np.maximum(sizes - LENGTH + 1, 0)
    return np.repeat(np.cumsum(sizes) - sizes - np.cumsum(room) + room, room) + np.arange(int(room.sum()))


def anchors(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor, first and last window start, gram hash), all counted in words, the last three over all texts."""
    start = _window_starts(sizes)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    grams = _sums(h, GRAM)
    at = start + np.lib.stride_tricks.sliding_window_view(grams, PLACES)[start].argmin(axis=1)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], start[first], start[last], grams[at[first]]


def _batched(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows and their texts, some ``FLUSH`` bytes at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for k, c in enumerate(batch.columns) if k != column]
        for k in range(batch.num_rows):
            raw = batch.column(column)[k].as_py()
            rows.append(tuple(c[k] for c in others))
            texts.append(raw)
            size += len(raw)
            if size >= FLUSH:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _many(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that occur at least so often, and how often."""
    cell = (h >> np.uint64(44)).astype(np.int64)
    some = h[np.bincount(cell, minlength=1 << 20)[cell] >= least]
    found, n = np.unique(some, return_counts=True)
    return found[n >= least], n[n >= least]


def _plan(texts: DataFrame) -> dict[int, dict[int, int]]:
    """By length of prefix (0: anchor's gram), the hashes with more than a share of all, and among how many tasks to deal them.

    A prefix of such a share has it in some batch of texts, so batches name only those they have many of: a bounded number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in _batched(batches, 0):
            h, sizes = word_hashes(raws)
            start = _window_starts(sizes)
            out = [(-1, 0, len(start))]
            *_, grams = anchors(h, sizes)
            for kind, hashes, shares in [(0, grams, HOT), *((n, own[start], SHARES) for n, own in zip(PREFIXES, _prefixes(h), strict=True))]:
                found, n = _many(hashes, max(4, len(hashes) // shares))
                out += [(kind, k, m) for k, m in zip(found.view(np.int64).tolist(), n.tolist(), strict=True)]
            out.append((-2, 0, len(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["kind", "h", "n"])

    counts = stored(texts.select("raw").mapInArrow(run, "kind int, h bigint, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("n")), "passage-plan")
    total = {r.kind: r.n for r in counts.where("kind < 0").collect()}
    limits = {kind: max(FEW, total.get(-1 if kind else -2, 0) // (SHARES if kind else HOT)) for kind in (0, *PREFIXES)}
    out: dict[int, dict[int, int]] = {kind: {} for kind in limits}
    for kind, limit in limits.items():  # no more than its number of shares each
        for r in counts.where((F.col("kind") == kind) & (F.col("n") > limit)).collect():
            out[kind][r.h] = -(-r.n // limit)
    return out


_KEY = ["t1", "t2"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, t1, t2) of all documents, how many documents have each text, and the distinct texts (t1, t2, first, raw) with the least id of each, bucketed."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    own = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID))
    each = docs.select(F.col(id_col).alias("doc_id"), own.alias("first"), F.xxhash64(raw).alias("t1"), F.pmod(F.xxhash64(F.lit(1), raw), F.lit(1 << KEY_BITS)).alias("t2"), raw.cast("binary").alias("raw"))
    spark = docs.sparkSession
    held = stored(each.groupBy(*_KEY).agg(F.min("first").alias("least"), F.count("*").alias("n")), "text-firsts")
    limit = max(FEW, (held.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = held.where(F.col("n") > limit).select(*_KEY, F.col("least").alias("_least")).collect()  # fewer than HOT
    rows = each.select(*_KEY, "first", "raw")
    order = F.row_number().over(Window.partitionBy(*_KEY).orderBy("first"))
    if hot:
        many = F.broadcast(spark.createDataFrame(hot, "t1 bigint, t2 bigint, _least bigint"))
        copies = rows.join(many, _KEY).groupBy(*_KEY).agg(F.min("_least").alias("first"), F.min("raw").alias("raw"))
        rows = rows.join(many, _KEY, "left_anti").unionByName(copies)
    n = partitions(spark)
    kept = rows.repartition(n, *_KEY).withColumn("_n", order).where("_n = 1").drop("_n")
    return each.select("doc_id", "first", *_KEY), held.select(*_KEY, "n"), bucketed(kept, "texts", _KEY, n)


def _anchored(texts: DataFrame) -> DataFrame:
    """(a, ctx, t1, place) for each anchor; ``place`` has the text's second hash, the anchor's word, and how far its first and last window start before it."""
    schema = "a bigint, ctx bigint, t1 bigint, place bigint"
    arrow = _arrow_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws in _batched(batches, 2):
            h, sizes = word_hashes(raws)
            owner, at, first, last, gram = anchors(h, sizes)
            data = memoryview(h.tobytes())
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(data[8 * f : 8 * (e + LENGTH)], seed=k - f) for k, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(at))
            begin = (np.cumsum(sizes) - sizes)[owner]
            t1, t2 = np.array(rows, np.int64).reshape(-1, 2)[owner].T
            place = t2 << AT_BITS | at - begin << 8 | at - first << 4 | at - last
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (gram.view(np.int64), ctx.view(np.int64), t1, place)], schema=arrow)

    return texts.where(F.octet_length("raw") >= 2 * LENGTH - 1).select(*_KEY, "raw").mapInArrow(run, schema)


def _shared(texts: DataFrame, rows: DataFrame, hot: dict[int, int]) -> DataFrame:
    """The anchors whose gram several places have, by text: (t1, t2, first, places); those of hot grams all count as such. Written once."""
    spark = rows.sparkSession
    if hot:
        tasks = F.broadcast(spark.createDataFrame(list(hot.items()), "a bigint, _tasks long"))  # fewer than HOT
        rows = rows.join(tasks, "a", "left")
    else:
        rows = rows.withColumn("_tasks", F.lit(None).cast("bigint"))
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("t1", "place"), F.col("_tasks")), F.lit(0)))
    alone = Window.partitionBy("a", "_salt")
    where = F.struct("t1", "place")
    some = rows.withColumn("_several", F.col("_tasks").isNotNull() | (F.min(where).over(alone) != F.max(where).over(alone))).where("_several")
    place = F.col("place").bitwiseAND((1 << AT_BITS) - 1).alias("place")
    found = some.groupBy("t1", F.shiftrightunsigned("place", AT_BITS).alias("t2")).agg(F.collect_list(F.struct(place, "a", "ctx")).alias("places"))
    return stored(found.join(texts.select(*_KEY, "first"), _KEY), "passage-anchors")


_SUFFIX = "bin int, salt int, head binary, a bigint, ctx bigint, shift int, first bigint"


def _suffixes(texts: DataFrame, contexts: DataFrame, plan: dict[int, dict[int, int]], tails: bool = False) -> DataFrame:
    """The suffixes of each context that begin with its windows, with the bin that the group of their prefix is in, and a salt above 0 where that prefix is a whole window.

    ``head`` is a suffix's window, which leads to its deep node; with ``tails`` what follows it in its context, which leads on below that.
    """
    schema = _SUFFIX + ", tail binary" * tails
    arrow = _arrow_schema(texts.sparkSession, schema)
    short, middle, whole = (np.array(sorted(plan[n]), np.int64) for n in PREFIXES)
    tasks = plan[LENGTH]
    bins = BINS * partitions(texts.sparkSession)
    wanted = contexts.groupBy("one.t1", "one.t2").agg(F.collect_list(F.struct("one.place", "a", "ctx", F.col("one.first").alias("first"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, size, since = [], 0, 0
            for k in range(batch.num_rows):
                raws.append(batch.column(0)[k].as_py())
                size += len(raws[-1])
                if size >= FLUSH or k + 1 == batch.num_rows:
                    yield from flush(raws, batch.column(1).slice(since, len(raws)))
                    raws, size, since = [], 0, k + 1

    def flush(raws: list[bytes], lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        h, sizes = word_hashes(raws)
        words = b" ".join(raws).split()
        hashes = [own.view(np.int64) for own in _prefixes(h)]
        # Words are counted over all texts; a place's above its text's first.
        shift = np.repeat((np.cumsum(sizes) - sizes) << 8, lists.value_lengths().to_numpy())
        place, a, ctx, first = (lists.flatten().field(k).to_numpy() for k in range(4))
        for at in range(0, len(place), 8_192):
            some = slice(at, at + 8_192)
            yield pa.RecordBatch.from_arrays(cut(words, hashes, (place + shift)[some], a[some], ctx[some], first[some]), schema=arrow)

    def cut(words: list[bytes], all_hashes: list[np.ndarray], place: np.ndarray, a: np.ndarray, ctx: np.ndarray, first: np.ndarray) -> list[pa.Array]:
        begin, end = (place >> 8) - (place >> 4 & 15), (place >> 8) - (place & 15) + LENGTH
        n = end - begin - LENGTH + 1
        row = np.repeat(np.arange(len(place)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[row] + shift
        hashes = [own[start] for own in all_hashes]
        longer = np.isin(hashes[0], short)
        longest = longer & np.isin(hashes[1], middle)
        group = np.where(longest, hashes[2], np.where(longer, hashes[1], hashes[0]))
        salt = np.zeros(len(row), np.int32)
        for k in np.flatnonzero(longest & np.isin(hashes[2], whole)).tolist():
            salt[k] = 1 + int(ctx[row[k]]) % tasks[int(group[k])]
        heads = [b" ".join(words[s : s + LENGTH]) for s in start.tolist()]
        columns = [(group.view(np.uint64) % np.uint64(bins)).astype(np.int32), salt, heads, a[row], ctx[row], shift.astype(np.int32), first[row]]
        if tails:
            columns.append([b" ".join(words[s + LENGTH : e]) for s, e in zip(start.tolist(), end[row].tolist(), strict=True)])
        return [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]

    return texts.select(*_KEY, "raw").join(wanted, _KEY).select("raw", "places").mapInArrow(run, schema)


def deep_nodes(tails: list[bytes]) -> list[tuple[int, int, int]]:
    """The internal nodes of a subtree whose leaves share a whole window, as (words beyond it, first leaf, leaf after the last).

    Leaves come sorted by what follows the window. A stack holds the open nodes.
    """
    words = [t.split() for t in tails]
    out, opened = [], [(0, 0)]
    for k in range(1, len(words)):
        n = 0
        for x, y in zip(words[k - 1], words[k], strict=False):
            if x != y:
                break
            n += 1
        begin = k - 1
        while opened and opened[-1][0] > n:
            depth, begin = opened.pop()
            out.append((depth, begin, k))
        if not opened or opened[-1][0] < n:
            opened.append((n, begin))
    out += [(depth, begin, len(words)) for depth, begin in opened[::-1]]
    return [node for node in out if node[2] - node[1] > 1]


_LEAF = "a bigint, ctx bigint, shift int, first bigint, least bigint, head bigint"


def _leaves(suffixes: DataFrame) -> DataFrame:
    """For each suffix below a deep internal node the least id of that node's leaves; of a salted one, of a part of them, with the hash of its path as ``head``."""
    arrow = _arrow_schema(suffixes.sparkSession, _LEAF)
    n = partitions(suffixes.sparkSession)
    ordered = suffixes.repartition(n, "bin", "salt").sortWithinPartitions("bin", "salt", "head").select("salt", "head", "a", "ctx", "shift", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            salt, first = (table.column(c).to_numpy() for c in ("salt", "first"))
            head = table.column("head").combine_chunks()
            same = np.append(False, (salt[1:] == salt[:-1]) & pc.equal(head[1:], head[:-1]).to_numpy(zero_copy_only=False))
            begin = np.flatnonzero(~same)
            least = np.repeat(np.minimum.reduceat(first, begin), np.diff(np.append(begin, len(first))))
            told = np.flatnonzero((salt > 0) | (least < first))
            part = table.take(pa.array(told))
            path = pa.array([xxhash.xxh64_intdigest(h.as_py()) - (1 << 63) if s else None for h, s in zip(part.column("head"), salt[told].tolist(), strict=True)], pa.int64())
            columns = [part.column(c).combine_chunks() for c in ("a", "ctx", "shift", "first")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(least[told]), path], schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            head, salt = table.column("head"), table.column("salt")
            # What may go on in the next batch stays: the leaves below the last node.
            last = table.num_rows - 1
            other = np.flatnonzero(~(pc.equal(head, head[last]).to_numpy() & (salt.to_numpy() == salt[last].as_py())))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield flush(table.slice(0, cut))
            held = [table.slice(cut).combine_chunks()]
        if held and held[0].num_rows:
            yield flush(pa.concat_tables(held))

    return stored(ordered.mapInArrow(run, _LEAF), "passage-leaves")


def _spans(texts: DataFrame) -> DataFrame:
    """(t1, t2, spans) of each text that loses words: marks of the windows to go beside their anchors' places."""
    plan = _plan(texts)
    shared = _shared(texts, _anchored(texts), plan[0])
    members = shared.select(*_KEY, "first", F.explode("places").alias("p")).select("p.a", "p.ctx", *_KEY, "first", "p.place")
    kind = ["a", "ctx"]
    contexts = stored(members.groupBy(*kind).agg(F.min(F.struct("first", *_KEY, "place")).alias("one"), F.count("*").alias("n")), "passage-contexts")
    leaves = _leaves(_suffixes(texts, contexts, plan))
    if plan[LENGTH]:
        least = F.broadcast(leaves.where("head IS NOT NULL").groupBy("head").agg(F.min("least").alias("_least")))  # at most SHARES
        leaves = leaves.join(least, "head", "left").withColumn("least", F.coalesce("_least", "least"))
    gone = leaves.where("least < first").groupBy(*kind).agg(F.expr("bit_or(shiftleft(1, shift))").alias("mask"))
    # The first place of a context loses the marked windows; later documents with it lose all.
    judged = contexts.join(gone, kind, "left").where("n > 1 OR mask IS NOT NULL").select(*kind, F.col("one.first").alias("_first"), F.coalesce("mask", F.lit(0)).alias("mask"), "n")
    told = spread_join(members, judged.drop("n"), kind, sizes=judged.select(*kind, "n"))
    mask = F.when(F.col("first") > F.col("_first"), F.lit((1 << PLACES) - 1)).otherwise(F.col("mask"))
    spans = told.select(*_KEY, "place", mask.cast("int").alias("mask")).where("mask > 0").groupBy(*_KEY)
    return spans.agg(F.collect_list(F.struct("place", "mask")).alias("spans"))


def _gone(n: int, spans: pa.StructArray) -> np.ndarray:
    """Which of ``n`` words go."""
    place, mask = spans.field("place").to_numpy(), spans.field("mask").to_numpy()
    begin, windows = (place >> 8) - (place >> 4 & 15), (place >> 4 & 15) - (place & 15) + 1
    turn = np.arange(PLACES)
    start = (begin[:, None] + turn)[(mask[:, None] >> turn & 1 > 0) & (turn < windows[:, None])]
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + LENGTH, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _judged(texts: DataFrame, spans: DataFrame, keep_text: bool) -> DataFrame:
    """(t1, t2, least, n_words, n_removed, kept_sha256, kept) of each text, as its first document has it."""
    schema = "t1 bigint, t2 bigint, least bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    arrow = _arrow_schema(texts.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for raw, own in zip(part.column(3), part.column(4), strict=True):
                    words = raw.as_py().split()
                    left = words
                    if own.is_valid:
                        left = [w for w, g in zip(words, _gone(len(words), own.values).tolist(), strict=True) if not g]
                    kept = b" ".join(left)
                    out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], schema=arrow)

    return texts.select(*_KEY, "first", "raw").join(spans, _KEY, "left").select(*_KEY, "first", "raw", "spans").mapInArrow(run, schema)


def _documents(docs: DataFrame, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    rows, sizes, texts = _texts(docs, id_col, text_col)
    judged = _judged(texts, _spans(texts), keep_text)
    both = spread_join(rows, judged, _KEY, sizes=sizes)
    copy = (F.col("first") > F.col("least")) & (F.col("n_words") >= LENGTH)  # an earlier document has all of its windows
    either = lambda c, other: F.when(copy, other).otherwise(F.col(c)).alias(c)
    kept = [either("kept", F.lit(""))] if keep_text else []
    return both.select("doc_id", "n_words", either("n_removed", F.col("n_words")), either("kept_sha256", F.lit(hashlib.sha256().hexdigest())), *kept)


def substring_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of documents (doc_id, text).

    A null text has no words; texts of fewer than ``LENGTH`` words lose none. Ids are whole numbers; a null id counts as the largest. Rows with the same id are none
    smaller than the other, so passages that only they share stay. Extra columns aren't read; an empty table gives no rows. A very long text is
    hashed in steps, and costs a task some times its size.
    """
    return _documents(docs, "doc_id", "text", False)


def without_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the kept words of each document, joined by one space."""
    return _documents(docs, id_col, text_col, True).select("doc_id", F.col("kept").alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(words, n_words, n_places, least): each repeat that can't be read further to the right at all its places, within the contexts of its first window.

    These are the paths of the deep internal nodes; ``n_places`` counts different contexts, ``least`` is the least id that has it. Salted nodes are left out.
    """
    *_, texts = _texts(docs, id_col, text_col)
    plan = _plan(texts) | {n: {} for n in PREFIXES}
    members = _shared(texts, _anchored(texts), plan[0]).select(*_KEY, "first", F.explode("places").alias("p")).select("p.a", "p.ctx", *_KEY, "first", "p.place")
    contexts = members.groupBy("a", "ctx").agg(F.min(F.struct("first", *_KEY, "place")).alias("one"))
    suffixes = _suffixes(texts, contexts, plan, tails=True)
    n = partitions(docs.sparkSession)
    ordered = suffixes.repartition(n, "bin").sortWithinPartitions("bin", "head", "tail").select("head", "tail", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(head: bytes, leaves: list[tuple[bytes, int]]) -> Iterator[tuple]:
            for depth, begin, end in deep_nodes([t for t, _ in leaves]):
                path = b" ".join([head, *leaves[begin][0].split()[:depth]]).decode()
                yield path, LENGTH + depth, end - begin, min(f for _, f in leaves[begin:end])

        now, held, out = None, [], []
        for batch in batches:
            for head, tail, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head != now and held:
                    out += flush(now, held)
                    held = []
                now = head
                held.append((tail, first))
                if len(out) >= 1_024:
                    yield pa.RecordBatch.from_pylist([dict(zip(("words", "n_words", "n_places", "least"), r, strict=True)) for r in out], schema=kind)
                    out = []
        if held:
            out += flush(now, held)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("words", "n_words", "n_places", "least"), r, strict=True)) for r in out], schema=kind)

    kind = _arrow_schema(docs.sparkSession, "words string, n_words int, n_places int, least bigint")
    return ordered.mapInArrow(run, "words string, n_words int, n_places int, least bigint")
