"""Removal of long repeated passages by run-compressed, positional Burrows-Wheeler transforms.

Each byte is removed that a string of ``LENGTH`` bytes covers which also starts
anywhere else. Every such string (a window) holds an anchor: the position of the
least hash of its ``GRAM``-byte grams, the first of equals. Equal windows have their
anchors at equal places, so they can be found anchor by anchor:

1. Each text's anchors are listed with the windows they stand for, which are
   consecutive, and a hash of the bytes that these windows cover, the anchor's context.
2. Grams that occur once have no repeated windows. If all occurrences of a gram have one context, the gram's
   transform is one run of as many rows in each column: all its windows are repeated, and its text isn't needed.
3. Of the others, each distinct context is fetched once, with the number of its occurrences. A gram's contexts are aligned at it,
   and ``RunIndex`` takes their transform column by column: rows are kept sorted by what they have read
   backwards, runs of equal symbols move as wholes, and the rows at the ends of runs are sampled with their
   match to the row beyond. Between two of its samples a row's neighbour stays the same and the match to it grows by
   one a column, so the samples alone give every row's matching statistics. Windows end where these reach ``LENGTH``.
   A context that occurs more than once is a run by itself.

Contexts go to tasks by gram, in order, and a task reads them as a stream, some thousands at a time. A gram with more than ``crowd``
distinct contexts is first parted: each ``PART`` consecutive windows, by their place from the anchor, share a core of
``LENGTH - PART + 1`` bytes, and only rows with the same core meet. Where even a core has more than ``crowd`` rows, windows are parted singly, so that equal rows are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, arrow_rows, kept, partitions, spread_join, stored

LENGTH, GRAM = 400, 32
WINDOW = LENGTH - GRAM + 1
#: Columns of aligned contexts: the gram starts in column ANCHOR.
ANCHOR = WINDOW - 1
#: Window starts of a text that are looked at together; windows that a crowded gram's rows keep together; contexts of a gram that one task takes.
PIECE, PART, CROWD = 1 << 17, 46, 2_048
_POSITION = np.uint64((1 << 32) - 1)
_CONTEXT = ["a", "ctx", "left", "right"]
_OUTSIDE, _NONE = 256, 1 << 30


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each position of a byte array."""
    w = buffer.astype(np.uint64)
    w = w[:-1] | w[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    w = w[:-4] | w[4:] << np.uint64(32)
    n, odd = len(buffer) - GRAM + 1, np.uint64(0x9E3779B97F4A7C15)
    h = w[:n] * odd
    h ^= h >> np.uint64(32)
    for at in range(8, GRAM, 8):
        h += w[at : at + n]
        h *= odd
        h ^= h >> np.uint64(29)
    return h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first and last window start, gram hash), positions within the text.

    The windows of an anchor start at ``first``, ..., ``last``.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = gram_hashes(np.frombuffer(b"".join(texts), np.uint8))
    n = len(h)
    fit = -n % WINDOW
    rows = np.concatenate([h & ~_POSITION | np.arange(n, dtype=np.uint64) & _POSITION, np.full(fit, ~np.uint64(0))]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    start = np.arange(len(least))
    owner = np.searchsorted(ends, start, side="right")
    fits = start + LENGTH <= ends[owner]
    start, owner = start[fits], owner[fits]
    at = start + ((least[fits] - start.astype(np.uint64)) & _POSITION).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    begin = (ends - sizes)[owner[first]]
    return owner[first], at[first] - begin, start[first] - begin, start[last] - begin, h[at[first]]


def _text_hash(text: Column, which: int) -> Column:
    """One of two 64-bit hashes of a text; a null text is empty."""
    given = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(1), given) if which else F.xxhash64(given)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, t1, t2, raw): 64 bits for the id, 128 bits that stand for the text, and its bytes."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("row"),
        _text_hash(F.col(text_col), 0).alias("t1"),
        _text_hash(F.col(text_col), 1).alias("t2"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"),
    )


def text_anchors(keyed: DataFrame) -> DataFrame:
    """(row, t1, t2, at, a, ctx, left, right) for each anchor: ``left`` and ``right`` say how far its first and last window start from it.

    Long texts are cut into pieces of ``PIECE`` window starts, and small texts are taken together up to that size; an anchor whose windows lie in two pieces has two contexts.
    """
    schema = "row bigint, t1 bigint, t2 bigint, at bigint, a bigint, ctx bigint, left int, right int"
    arrow = _arrow_schema(keyed.sparkSession, schema)

    def flush(rows: list[tuple], raws: list[bytes]) -> pa.RecordBatch:
        owner, at, first, last, gram = anchors(raws)
        ctx = np.fromiter((xxhash.xxh3_64_intdigest(raws[o][f : e + LENGTH]) for o, f, e in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(owner))
        keys = np.array(rows, np.int64).reshape(-1, 4)[owner]
        columns = [keys[:, 0], keys[:, 1], keys[:, 2], keys[:, 3] + at, gram.view(np.int64), ctx.view(np.int64), (at - first).astype(np.int32), (at - last).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, raws, size = [], [], 0
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, value in zip(keys, batch.column(3), strict=True):
                raw = value.as_py()
                for base in range(0, len(raw) - LENGTH + 1, PIECE):
                    piece = raw[base : base + PIECE + LENGTH - 1] if len(raw) > PIECE else raw
                    if size + len(piece) > PIECE and rows:
                        yield flush(rows, raws)
                        rows, raws, size = [], [], 0
                    rows.append((*key, base))
                    raws.append(piece)
                    size += len(piece)
        if rows:
            yield flush(rows, raws)

    return keyed.where(F.octet_length("raw") >= LENGTH).select("row", "t1", "t2", "raw").mapInArrow(run, schema)


@dataclass
class RunIndex:
    """The run-compressed positional transform of the contexts of some grams, and its samples.

    For each run of a column in which its gram has several runs: the ``column``, the ``symbol`` (256: no byte), the run's ``length`` in rows,
    the rows at its two ends once it has moved (``first``, ``last``), and the columns since when these match the row before (``above``) and after (``below``);
    ``_NONE`` if there is none. A column in which a gram is one run changes nothing and isn't kept.
    """

    column: np.ndarray
    symbol: np.ndarray
    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    above: np.ndarray
    below: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], begin: np.ndarray, group: np.ndarray) -> RunIndex:
        """Of texts that begin in the columns ``begin``, for the grams ``group``, in order of these."""
        n = len(texts)
        end = begin + np.array([len(t) for t in texts])
        k0, k1 = int(begin.min()), int(end.max())
        cells = np.full((n, k1 - k0), _OUTSIDE, np.int16)
        for row, b, t in zip(cells, (begin - k0).tolist(), texts, strict=True):
            row[b : b + len(t)] = np.frombuffer(t, np.uint8)
        cells = np.ascontiguousarray(cells.T)
        order, since = np.arange(n), np.full(n + 1, k0)
        head = np.ones(n, bool)  # whether a place is the first of its gram
        head[1:] = group[1:] != group[:-1]
        number, starts = np.cumsum(head) - 1, np.flatnonzero(head)
        whole = range(int(begin.max()), int(end.min()))
        out: list[tuple] = []
        for k in range(k0, k1):
            symbol = cells[k - k0][order]
            cut = head.copy()
            cut[1:] |= symbol[1:] != symbol[:-1]
            bounds = np.flatnonzero(cut)
            if len(bounds) > len(starts):
                several = np.add.reduceat(cut, starts, dtype=np.int64) > 1
                mine = several[number[bounds]]
                at, size = bounds[mine], np.diff(np.append(bounds, n))[mine]
                gram, mark = number[at], symbol[at].astype(np.int64)
                turn = np.argsort(gram * 512 + mark, kind="stable")
                at, size, gram, mark = at[turn], size[turn], gram[turn], mark[turn]
                place = np.cumsum(size) - size
                fresh = np.full(len(at) + 1, k + 1)
                fresh[-1] = _NONE
                fresh[:-1][np.append(True, gram[1:] != gram[:-1])] = _NONE
                joined = np.flatnonzero((gram[1:] == gram[:-1]) & (mark[1:] == mark[:-1])) + 1
                if len(joined):
                    ranges = np.empty(2 * len(joined), np.int64)
                    ranges[::2], ranges[1::2] = at[joined - 1] + size[joined - 1], at[joined] + 1
                    fresh[joined] = np.maximum.reduceat(since, ranges)[::2]
                source = np.repeat(at - place, size) + np.arange(size.sum())
                target = np.flatnonzero(several[number])
                order[target], symbol[target], since[target] = order[source], symbol[source], since[source]
                since[target[place]] = fresh[:-1]
                out.append((np.full(len(at), k), mark, size, order[target[place]], order[target[place + size - 1]], fresh[:-1], fresh[1:]))
            if k not in whole:
                since[:n][symbol == _OUTSIDE] = k + 1
        return cls(*(np.concatenate(c) for c in zip(*out, strict=True))) if out else cls(*(np.zeros(0, np.int64) for _ in range(7)))

    def repeated(self, begin: np.ndarray, end: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which windows of each row (by the column they start in) occur more than once: from each sample on, where the match is long enough."""
        n = len(begin)
        marks = np.zeros((n, ANCHOR + LENGTH + 2), np.int32)
        flat, width = marks.reshape(-1), marks.shape[1]
        edge = np.ones(n + 1, bool)
        edge[1:n] = group[1:] != group[:-1]
        for rows, since, alone in ((self.first, self.above, edge[:n]), (self.last, self.below, edge[1:])):
            row = np.concatenate([np.arange(n), rows])
            column = np.concatenate([begin, self.column])
            match = np.concatenate([np.where(alone, _NONE, begin), since])
            turn = np.argsort(row, kind="stable")
            row, column, match = row[turn], column[turn], match[turn]
            until = np.append(column[1:], 0)
            until[np.append(row[1:] != row[:-1], True)] = width
            low = np.maximum(column, np.maximum(match, begin[row]) + LENGTH - 1)
            high = np.minimum(until, end[row])
            some = low < high
            np.add.at(flat, row[some] * width + low[some] - LENGTH + 1, 1)
            np.add.at(flat, row[some] * width + high[some] - LENGTH + 1, -1)
        found = np.cumsum(marks, axis=1)[:, :WINDOW] > 0
        columns = np.arange(WINDOW)
        return found | ((weight > 1)[:, None] & (columns >= begin[:, None]) & (columns <= end[:, None] - LENGTH))


def repeated_windows(texts: list[bytes], left: np.ndarray, group: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For contexts of the grams ``group``, in order of these: which windows (columns, by ``ANCHOR - left`` of the first) occur more than once among the gram's contexts, each taken ``weight`` times."""
    begin = ANCHOR - left
    end = begin + np.array([len(t) for t in texts])
    weight = np.ones(len(texts), np.int64) if weight is None else weight
    return RunIndex.of(texts, begin, group).repeated(begin, end, group, weight)


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


_ROW = "a bigint, sub bigint, ctx bigint, left int, right int, low int, high int, n bigint, many boolean, raw binary"
_FOUND = "a bigint, ctx bigint, left int, right int, first array<int>, beyond array<int>"


def _indexed(batches: Iterator[pa.RecordBatch], most: int = 2_048) -> Iterator[pa.RecordBatch]:
    """The repeated windows of each row, as runs from ``first`` to before ``beyond``, counted from the anchor.

    Rows come sorted by (a, sub); at most ``most`` and a group more are held.
    """
    schema = pa.schema([("a", pa.int64()), ("ctx", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("first", pa.list_(pa.int32())), ("beyond", pa.list_(pa.int32()))])

    def flush(table: pa.Table) -> pa.RecordBatch:
        get = lambda c: table.column(c).to_numpy()
        key = np.stack([get(c).astype(np.int64) for c in ("a", "sub", *_CONTEXT[1:], "low")], axis=1)
        key_new = np.ones(len(key), bool)
        key_new[1:] = (key[1:] != key[:-1]).any(axis=1)
        if not key_new.all():  # rows that repeat in the input, id and all, have fetched a context more than once
            table, key = table.filter(pa.array(key_new)), key[key_new]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:, :2] != key[:-1, :2]).any(axis=1)
        flags = repeated_windows(table.column("raw").to_pylist(), get("low").astype(np.int64), np.cumsum(new), get("n"))
        hit = np.flatnonzero(flags.any(axis=1))
        runs = [_runs(flags[i]) for i in hit.tolist()]
        kept = table.take(pa.array(hit)).combine_chunks()
        first, beyond = ([[x - ANCHOR for x in r[side]] for r in runs] for side in (0, 1))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in map(kept.column, _CONTEXT)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.list_(pa.int32())), pa.array(beyond, pa.list_(pa.int32()))], schema=schema)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            size += held[-1].num_rows
            if size >= most:
                table = pa.Table.from_batches(held)
                a, sub = table.column("a").to_numpy(), table.column("sub").to_numpy()
                last = np.flatnonzero((a != a[-1]) | (sub != sub[-1]))
                if len(last):
                    cut = int(last[-1]) + 1
                    yield flush(table.slice(0, cut))
                    table = table.slice(cut).combine_chunks()
                held, size = table.to_batches(), table.num_rows
    if size:
        yield flush(pa.Table.from_batches(held))


_SLICE = ["a", "sub", "slice", "low", "high"]


def _slices(rows: DataFrame, size: int) -> DataFrame:
    """(a, sub, slice, low, high, ctx, left, right, n): rows cut to ``size`` consecutive windows of the gram's grid each, without their bytes.

    ``sub`` is a hash of the part and the bytes that all its windows share, ``slice`` one of all its bytes.
    """

    def cut(a: list, ctx: list, left: list, right: list, low: list, high: list, n: list, raw: list) -> dict[str, list]:
        out = []
        for g, c, le, ri, lo, hi, w, t in zip(a, ctx, left, right, low, high, n, raw, strict=True):
            begin, last = ANCHOR - lo, ANCHOR - hi  # first and last window start, as columns
            for p in range(begin // size, last // size + 1):
                b, e = max(begin, p * size), min(last, p * size + size - 1)
                core = t[p * size + size - 1 - begin : p * size + LENGTH - begin]
                sub, whole = xxhash.xxh3_64_intdigest(core, seed=p), xxhash.xxh3_64_intdigest(t[b - begin : e - begin + LENGTH], seed=p)
                out.append((g, sub - (sub >> 63 << 64), whole - (whole >> 63 << 64), ANCHOR - b, ANCHOR - e, c, le, ri, w))
        names = [*_SLICE, "ctx", "left", "right", "n"]
        return dict(zip(names, map(list, zip(*out, strict=True)) if out else [[]] * len(names), strict=True))

    given = rows.select("a", "ctx", "left", "right", "low", "high", "n", "raw")
    return arrow_rows(given, cut, "a bigint, sub bigint, slice bigint, low int, high int, ctx bigint, left int, right int, n bigint", rows=64)


def _index(rows: DataFrame) -> DataFrame:
    """The repeated windows of rows by (a, sub), each such group being a task's at once."""
    return rows.repartition(partitions(rows.sparkSession), "a", "sub").sortWithinPartitions("a", "sub", "ctx", "left", "right", "low").mapInArrow(_indexed, _FOUND)


def _parted(rows: DataFrame, crowd: int) -> DataFrame:
    """As ``_index``, for rows of grams with more than ``crowd`` contexts each.

    Slices that are equal become one, counted, before they are sorted; only those whose core occurs more than once are fetched.
    """
    each = stored(_slices(rows, PART), "passage-slices")
    slices = kept(each.groupBy(*_SLICE).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(F.struct("ctx", "left", "right")).alias("one")))
    cores = kept(slices.groupBy("a", "sub").agg(F.count("*").alias("slices"), F.sum("n").alias("all")).where(F.col("all") > 1))
    told = spread_join(slices, cores, ["a", "sub"], sizes=cores.select("a", "sub", F.col("slices").alias("n")))
    # One row of each slice has the bytes.
    some = told.where(F.col("slices") <= crowd).select("a", "sub", "slice", "low", "high", "n", F.col("one.ctx").alias("ctx"), F.col("one.left").alias("left"), F.col("one.right").alias("right"))
    raw = some.join(rows.select(*_CONTEXT, F.col("low").alias("_low"), "raw").dropDuplicates(_CONTEXT), _CONTEXT)
    cut = raw.select("a", "sub", F.col("slice").alias("ctx"), F.col("low").alias("left"), F.col("high").alias("right"), "low", "high", "n", F.expr(f"substring(raw, _low - low + 1, low - high + {LENGTH})").alias("raw"))
    hits = _index(cut).select("a", F.col("ctx").alias("slice"), F.col("left").alias("low"), F.col("right").alias("high"), "first", "beyond")
    back = spread_join(each, hits, ["a", "slice", "low", "high"], sizes=slices.select("a", "slice", "low", "high", F.col("rows").alias("n"))).select(*_CONTEXT, "first", "beyond")
    crowded = cores.where(F.col("slices") > crowd).select("a", "sub")
    if crowded.isEmpty():
        return back
    # A window by itself is its own core: all rows of one are equal.
    wide = spread_join(each, crowded, ["a", "sub"], sizes=cores.select("a", "sub", F.col("all").alias("n"))).select("a", "low", "high", "ctx", "left", "right", "n")
    whole = wide.join(rows.select(*_CONTEXT, F.col("low").alias("_low"), "raw").dropDuplicates(_CONTEXT), _CONTEXT)
    cut = whole.withColumn("raw", F.expr(f"substring(raw, _low - low + 1, low - high + {LENGTH})"))
    windows = stored(_slices(cut, 1), "passage-windows")
    twice = kept(windows.groupBy(*_SLICE).agg(F.sum("n").alias("n")).where("n > 1"))
    single = spread_join(windows, twice.drop("n"), _SLICE, sizes=twice)
    return back.unionByName(single.select(*_CONTEXT, F.array(-F.col("low")).alias("first"), F.array(1 - F.col("low")).alias("beyond")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(t1, t2, row, spans array<struct<begin, end>>): byte ranges to remove from the texts with that key, not merged; ``row`` is one row that has the text."""
    keyed = _keyed(docs, id_col, text_col).where(F.octet_length("raw") >= LENGTH)
    every = kept(text_anchors(keyed))
    kind = F.struct("ctx", "left", "right")
    grams = kept(every.groupBy("a").agg(F.count("*").alias("n"), (F.min(kind) != F.max(kind)).alias("mixed")).where("n > 1"))
    total = every.count()
    place = ["t1", "t2", "at", *_CONTEXT]
    held = spread_join(every, grams.select("a", "mixed"), ["a"], sizes=grams.select("a", "n"), total=total)
    # Copies of a text become one here, counted.
    held = stored(held.groupBy(*place, "mixed").agg(F.count("*").alias("n"), F.min("row").alias("row")), "passage-repeats")
    mixed = held.where("mixed")
    contexts = kept(mixed.groupBy(*_CONTEXT).agg(F.sum("n").alias("n"), F.min(F.struct("row", "t1", "t2", "at")).alias("one")))
    crowded = contexts.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    crowds = not crowded.isEmpty()
    if crowds:
        crowded = kept(crowded)
        flagged = spread_join(contexts, crowded.select("a", F.lit(True).alias("many")), ["a"], "left", sizes=crowded, total=total)
    else:
        flagged = contexts.withColumn("many", F.lit(None).cast("boolean"))
    wanted = flagged.groupBy("one.row", "one.t1", "one.t2").agg(F.collect_list(F.struct(F.col("one.at").alias("at"), *_CONTEXT, "n", "many")).alias("places"))
    rows = stored(_cut(keyed.select("row", "t1", "t2", "raw").join(wanted, ["row", "t1", "t2"]).select("raw", "places")), "passage-rows")
    found = _index(rows.where("many IS NULL"))
    if crowds:
        found = found.unionByName(_parted(rows.where("many"), crowd))
    found = found.groupBy(*_CONTEXT).agg(F.flatten(F.collect_list(F.arrays_zip("first", "beyond"))).alias("runs"))
    singles = spread_join(mixed, found, _CONTEXT, sizes=contexts.select(*_CONTEXT, "n"), total=total)
    runs = singles.select("t1", "t2", "row", "at", F.explode("runs").alias("r"))
    span = lambda begin, end: F.struct(begin.alias("begin"), end.alias("end")).alias("span")
    parted = runs.select("t1", "t2", "row", span(F.col("at") + F.col("r.first"), F.col("at") + F.col("r.beyond") - 1 + LENGTH))
    whole = held.where("NOT mixed").select("t1", "t2", "row", span(F.col("at") - F.col("left"), F.col("at") - F.col("right") + LENGTH))
    return whole.union(parted).groupBy("t1", "t2").agg(F.min("row").alias("row"), F.collect_list("span").alias("spans"))


def _cut(fetched: DataFrame) -> DataFrame:
    """The rows of contexts from (raw, places)."""
    arrow = _arrow_schema(fetched.sparkSession, _ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw, places = batch.column(0)[k].as_py(), batch.column(1)[k].values
                at, left, right = (places.field(c).to_numpy() for c in ("at", "left", "right"))
                for some in range(0, len(at), 4_096):
                    part = places.slice(some, 4_096)
                    begins, ends = (at - left)[some : some + 4_096].tolist(), (at - right)[some : some + 4_096].tolist()
                    texts = pa.array([raw[b : e + LENGTH] for b, e in zip(begins, ends, strict=True)], pa.binary())
                    columns = {c: part.field(c) for c in (*_CONTEXT, "n", "many")} | {"sub": pa.array(np.zeros(len(texts), np.int64)), "low": part.field("left"), "high": part.field("right"), "raw": texts}
                    yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

    return fetched.mapInArrow(run, _ROW)


def _gone(size: int, spans: pa.Array) -> np.ndarray:
    """Which bytes the spans cover."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, spans.field("begin").to_numpy(), 1)
    np.add.at(edges, spans.field("end").to_numpy(), -1)
    return np.cumsum(edges[:-1]) > 0


def _kept(keyed: DataFrame, found: DataFrame, schema: str, row) -> DataFrame:
    """(t1, t2, and the columns of ``schema``) for each text that loses something: what ``row`` makes of its bytes and marks of those lost."""
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = _arrow_schema(keyed.sparkSession, f"t1 bigint, t2 bigint, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 64):
                part = batch.slice(some, 64)
                out = []
                for raw, spans in zip(part.column(2), part.column(3), strict=True):
                    data = raw.as_py()
                    out.append(row(np.frombuffer(data, np.uint8), _gone(len(data), spans.values)))
                columns = [pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=arrow)

    joined = keyed.where(F.octet_length("raw") >= LENGTH).select("row", "t1", "t2", "raw").join(found, ["row", "t1", "t2"]).select("t1", "t2", "raw", "spans")
    # Rows that repeat, id and all, give the same row more than once.
    return joined.mapInArrow(run, f"t1 bigint, t2 bigint, {schema}").dropDuplicates(["t1", "t2"])


def passage_digests(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents (doc_id, text).

    Rows of one id, or with the same text, are documents of their own: their strings start elsewhere. Texts of less than ``LENGTH`` bytes lose nothing;
    a null text is empty. Texts are read piece by piece, so a very long one costs no more than some times its own size.
    """
    keyed = _keyed(docs, "doc_id", "text")
    rows = keyed.select("doc_id", "t1", "t2", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("all_sha256"))

    def digest(raw: np.ndarray, gone: np.ndarray) -> tuple:
        return int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(raw[~gone]).hexdigest()

    lost = _kept(keyed, repeated_spans(docs, crowd=crowd), "n_removed bigint, n_spans bigint, kept_sha256 string", digest)
    none = lambda c, other: F.coalesce(F.col(c), other).alias(c)
    joined = spread_join(rows, lost, ["t1", "t2"], "left")
    return joined.select("doc_id", "n_bytes", none("n_removed", F.lit(0).cast("bigint")), none("n_spans", F.lit(0).cast("bigint")), none("kept_sha256", F.col("all_sha256")))


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with repeated passages removed; bytes of a cut character that are left over become U+FFFD."""
    keyed = _keyed(docs, id_col, text_col)

    def left(raw: np.ndarray, gone: np.ndarray) -> tuple:
        return (raw[~gone].tobytes().decode("utf-8", "replace"),)

    text = F.col(text_col)
    lost = _kept(keyed, repeated_spans(docs, id_col, text_col), "left string", left)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _text_hash(text, 0).alias("t1"), _text_hash(text, 1).alias("t2"))
    return spread_join(rows, lost, ["t1", "t2"], "left").select("doc_id", F.coalesce("left", "text").alias("text"))
