"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased. The index
has, for each shard of the key space,

* exact counts (hi, lo, n): how many documents hold the key with that 128-bit hash;
* a cuckoo filter of the keys that at least ``SHARED`` documents hold.

Inserting documents adds to the counts, and keys that reach ``SHARED`` enter the
filter. Deleting documents subtracts, and keys that fall below leave it; a cuckoo filter can
forget a key, which a Bloom filter can't. So an index after any insertions and deletions
equals one built from the documents that remain.

To deduplicate, each line asks the filter of its shard, where that lies: keys and filters are
dealt by shard, and the keys are streamed past the filter. The few that it lets through are
checked against the exact counts, the smallest document of each key is found, and
the others lose the line. Counts are added up by Spark before anything is shuffled; a task's Python holds one filter, the
shared keys of one shard while that is built, and a small batch of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, dealt, fresh, kept, partitions, spread_join, stored

SHARED, LEAST, BLANK = 2, 10, b" \t\n\r\x0b\x0c"


class Full(Exception):
    """A filter has no place left; it is rebuilt larger from the exact counts."""


class CuckooFilter:
    """A set of 128-bit keys as 16-bit marks in buckets of four, each mark in one of two buckets. Keys are given as arrays of their halves."""

    SLOTS, ROUNDS = 4, 400

    def __init__(self, cells: np.ndarray):
        self.cells = cells.reshape(-1, self.SLOTS)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 4
        while buckets * cls.SLOTS * 0.8 < keys:
            buckets *= 2
        return cls(np.zeros(buckets * cls.SLOTS, np.uint16))

    def _homes(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum((hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16), np.uint16(1))
        one = lo & (len(self.cells) - 1)
        return mark, one, self._other(mark, one)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (((mark.astype(np.int64) * 0x5BD1E995) >> 7) & (len(self.cells) - 1))

    def may_hold(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, one, two = self._homes(hi, lo)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def _take(self, wanted: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key a slot of either bucket that holds ``wanted``, and which keys get it: one key a slot."""
        first, second = self.cells[one] == wanted[:, None], self.cells[two] == wanted[:, None]
        in_one, in_two = first.any(axis=1), second.any(axis=1)
        slot = np.where(in_one, one * self.SLOTS + first.argmax(axis=1), two * self.SLOTS + second.argmax(axis=1))
        able = np.flatnonzero(in_one | in_two)
        return slot, able[np.unique(slot[able], return_index=True)[1]]

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """All keys at once, round by round; marks that a mark pushes out move to their other bucket."""
        mark, one, two = self._homes(hi, lo)
        flat = self.cells.reshape(-1)
        for turn in range(self.ROUNDS):
            slot, lucky = self._take(np.zeros(len(mark), np.uint16), one, two)
            flat[slot[lucky]] = mark[lucky]
            left = np.ones(len(mark), bool)
            left[lucky] = False
            mark, one, two = mark[left], one[left], two[left]
            if not len(mark):
                return
            full = np.flatnonzero((self.cells[one] != 0).all(axis=1) & (self.cells[two] != 0).all(axis=1))
            slot = two[full] * self.SLOTS + (mark[full] + turn) % self.SLOTS
            pushed, which = np.unique(slot, return_index=True)
            movers = full[which]
            old = flat[pushed]
            flat[pushed] = mark[movers]
            mark[movers], one[movers] = old, two[movers]
            two[movers] = self._other(old, one[movers])
        raise Full

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Forgets keys that were added."""
        mark, one, two = self._homes(hi, lo)
        flat = self.cells.reshape(-1)
        while len(mark):
            slot, lucky = self._take(mark, one, two)
            if not len(lucky):
                raise KeyError(f"{len(mark)} keys that the filter doesn't hold")
            flat[slot[lucky]] = 0
            left = np.ones(len(mark), bool)
            left[lucky] = False
            mark, one, two = mark[left], one[left], two[left]

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        room = len(hi)
        while True:
            found = cls.sized(room)
            try:
                found.add(hi, lo)
                return found
            except Full:
                room = max(2 * room, int(found.cells.size))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(shards)).cast("int").alias("shard")


def _digest(line: bytes) -> bytes | None:
    """The 128-bit hash of a line's key; None if the key is shorter than ``LEAST`` code points."""
    key = line.strip(BLANK)
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "replace")) < LEAST:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) for each key of each row, once a row."""
    schema = "doc_id bigint, hi bigint, lo bigint"
    arrow, flush = _arrow_schema(docs.sparkSession, schema), 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, owners, counts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            ids = pa.array(owners, pa.int64()).take(pa.array(np.repeat(np.arange(len(owners)), counts)))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], schema=arrow)

        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                found = set(map(_digest, (text.as_py() or b"").lower().split(b"\n")))
                found.discard(None)
                if found:
                    digests.append(b"".join(found))
                    owners.append(own.as_py())
                    counts.append(len(found))
                    size += len(found)
                if size >= flush:
                    yield out()
                    digests, owners, counts, size = [], [], [], 0
        if size:
            yield out()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(run, schema)


_FILTERS = "shard int, cells binary"


def _changed_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filters of shards, from rows sorted by shard, a shard's old filter first: (shard, cells, hi, lo, change), ``change`` being -1, 1 or 0 for keys that leave, enter or stay."""
    schema = pa.schema([("shard", pa.int32()), ("cells", pa.binary())])

    def made(shard: int, cells: bytes | None, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        hi, lo, change = (np.ascontiguousarray(c) for c in rows.T)
        try:
            if cells is None:
                raise Full
            held = CuckooFilter(np.frombuffer(cells, np.uint16).copy())
            held.remove(hi[change < 0], lo[change < 0])
            held.add(hi[change > 0], lo[change > 0])
        except Full:
            held = CuckooFilter.of(hi[change >= 0], lo[change >= 0])
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([held.cells.tobytes()], pa.binary())], schema=schema)

    now, cells, parts = None, None, []
    for b in batches:
        shards = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if to == at:
                continue
            if int(shards[at]) != now:
                if now is not None:
                    yield made(now, cells, parts)
                now, cells, parts = int(shards[at]), None, []
            part = b.slice(at, to - at)
            if part.column("cells")[0].is_valid:
                cells, part = part.column("cells")[0].as_py(), part.slice(1)
            parts.append(np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("hi", "lo", "change")], axis=1))
    if now is not None:
        yield made(now, cells, parts)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that their shard's filter may hold: rows (shard, _task, cells, doc_id, hi, lo), sorted, the filter first."""
    held, now = None, None
    for b in batches:
        both = np.stack([b.column("shard").to_numpy().astype(np.int64), b.column("_task").to_numpy().astype(np.int64)], axis=1)
        cuts = [0, *(np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1).tolist(), len(both)]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if to == at:
                continue
            part = b.slice(at, to - at)
            if tuple(both[at]) != now:
                held, now = None, tuple(both[at])
            if part.column("cells")[0].is_valid:
                held, part = CuckooFilter(np.frombuffer(part.column("cells")[0].as_py(), np.uint16)), part.slice(1)
            if held is not None and part.num_rows:
                may = held.may_hold(part.column("hi").to_numpy(), part.column("lo").to_numpy())
                yield part.select(["doc_id", "hi", "lo"]).filter(pa.array(may))


@dataclass
class LineIndex:
    """``counts``: (shard, hi, lo, n), how many documents hold each key; ``filters``: (shard, cells)."""

    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int | None = None) -> LineIndex:
        """By default four shards for each shuffle partition; the shared keys of a shard, 16 bytes each, have to fit into a task."""
        return cls(spark.createDataFrame([], "shard int, hi bigint, lo bigint, n bigint"), spark.createDataFrame([], _FILTERS), shards or 4 * partitions(spark))

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(line_keys(docs.withColumn(fresh("_id", docs), F.lit(0)), fresh("_id", docs), text_col), 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        """Takes documents out again, given with the texts they were inserted with. It is an error to delete what isn't there."""
        return self._changed(line_keys(docs.withColumn(fresh("_id", docs), F.lit(0)), fresh("_id", docs), text_col), -1)

    def _changed(self, keys: DataFrame, sign: int, lasting: bool = True) -> LineIndex:
        """``lasting`` tables end lineage, which would grow with each change of an index; one query's own index is part of its plan."""
        put = stored if lasting else lambda df, _: df
        new = keys.groupBy("hi", "lo").agg((F.lit(sign) * F.count("*")).alias("delta")).select(_shard(self.shards), "hi", "lo", F.lit(0).cast("bigint").alias("old"), "delta")
        both = self.counts.select("shard", "hi", "lo", F.col("n").alias("old"), F.lit(0).cast("bigint").alias("delta")).union(new)
        summed = both.groupBy("shard", "hi", "lo").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("delta")).alias("n"))
        checked = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("a document was deleted that the index doesn't hold")))
        exact = put(summed.select("shard", "hi", "lo", "old", checked.alias("n")), "line-counts")
        change = (F.col("n") >= SHARED).cast("int") - (F.col("old") >= SHARED).cast("int")
        moved = exact.where((F.col("n") >= SHARED) | (F.col("old") >= SHARED)).select("shard", F.lit(None).cast("binary").alias("cells"), "hi", "lo", change.alias("change"))
        nothing = F.lit(0).cast("bigint")
        rows = moved.union(self.filters.select("shard", "cells", nothing, nothing, F.lit(0)))
        rows = rows.repartition(min(self.shards, partitions(keys.sparkSession)), "shard").sortWithinPartitions("shard", F.col("cells").isNull())
        return LineIndex(exact.where("n > 0").select("shard", "hi", "lo", "n"), put(rows.mapInArrow(_changed_filters, _FILTERS), "line-filters"), self.shards)

    def _lost(self, keys: DataFrame, batch: bool) -> DataFrame:
        """(doc_id, hi, lo) of ``keys`` to be lost; rows of one id may repeat."""
        spark = keys.sparkSession
        asked = keys.select(_shard(self.shards), "doc_id", "hi", "lo")
        parts, filters = dealt(asked, self.filters, ["shard"]) or (asked.withColumn("_task", F.lit(0)), self.filters.withColumn("_task", F.lit(0)))
        none = F.lit(None).cast("bigint")
        rows = parts.select("shard", "_task", F.lit(None).cast("binary").alias("cells"), "doc_id", "hi", "lo").union(filters.select("shard", "_task", "cells", none, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
        rows = rows.repartition(partitions(spark), "shard", "_task").sortWithinPartitions("shard", "_task", F.col("cells").isNull())
        found = stored(rows.mapInArrow(_screened, "doc_id bigint, hi bigint, lo bigint"), "line-candidates")
        # Rows without an id come after all others and count as one document.
        place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
        first = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("m"))
        shared = self.counts.where(F.col("n") >= SHARED).select("hi", "lo", F.col("n").alias("_n"))
        before = F.col("_n") > F.col("m") if batch else F.lit(False)
        exact = first.join(shared, ["hi", "lo"]).where(before | (F.col("first") < F.col("last"))).select("hi", "lo", "first", before.alias("before"))
        joined = spread_join(found, exact, ["hi", "lo"])
        return joined.where(F.col("before") | (place > F.col("first"))).select("doc_id", "hi", "lo")

    def duplicates(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: bool = False) -> DataFrame:
        """(doc_id, hi, lo): keys each document loses, being held by a smaller id. ``docs`` are the indexed documents.

        If ``docs`` are a ``batch``, the last documents inserted, all others in the index come before them: a key that
        one of those holds goes from the whole batch. Only the batch is read for it, since the counts tell whether others hold a key.
        """
        return self._lost(kept(line_keys(docs, id_col, text_col)), batch).distinct()


def without_lines(raw: bytes, gone: set[bytes]) -> tuple[bytes, int, int]:
    """The text left, with the number of its lines and of those dropped: those whose keys' hashes are ``gone``."""
    lines = raw.split(b"\n")
    if not gone:
        return raw, len(lines), 0
    kept = [line for line in lines if _digest(line.lower()) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _digests(gone: pa.ListScalar) -> set[bytes]:
    """The hashes of a list of (hi, lo); none if it is null."""
    if not gone.is_valid:
        return set()
    data = np.stack([gone.values.field(c).to_numpy() for c in ("hi", "lo")], axis=1).astype(">i8").tobytes()
    return {data[at : at + 16] for at in range(0, len(data), 16)}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None, batch: bool = False, gone_col: str = "_gone") -> DataFrame:
    """All columns of ``docs`` as they are, with ``gone_col``: the hashes (hi, lo) of the keys whose lines the row is to lose.

    Without an index, one is built of ``docs``. With one, ``docs`` are all documents in it, which are read again, or, with
    ``batch``, those inserted last, judged against all before them (see ``LineIndex.duplicates``). Rows of one id count as one document; rows without an id
    together come after all others. Null and empty texts are one empty line.
    """
    keys = kept(line_keys(docs, id_col, text_col))
    index = index or LineIndex.empty(docs.sparkSession)._changed(keys, 1, lasting=False)
    own = fresh("_line_id", docs)
    lost = index._lost(keys, batch).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("hi", "lo")).alias(gone_col))
    return docs.join(lost, docs[id_col].cast("bigint").eqNullSafe(lost[own]), "left").select(*(docs[c] for c in docs.columns), gone_col)


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of documents (doc_id, text)."""
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                raw, n, dropped = without_lines(text.as_py() or b"", _digests(gone))
                out.append((n, dropped, hashlib.sha256(raw).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(arrow)[1:], strict=True))], schema=arrow)

    marked = dedup_lines(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), "_gone")
    return marked.mapInArrow(run, schema)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None, batch: bool = False) -> DataFrame:
    """The rows with their texts deduplicated, in the columns of ``docs``; a null text stays null. ``index`` and ``batch`` as in ``dedup_lines``."""
    gone_col = fresh("_gone", docs)
    marked = dedup_lines(docs, id_col, text_col, index, batch, gone_col)
    at, kept = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(at).type
            texts = [t.as_py() if not g.is_valid else without_lines(t.as_py().encode("utf-8", "surrogatepass"), _digests(g))[0].decode("utf-8", "surrogatepass") for t, g in zip(batch.column(at), batch.column(kept), strict=True)]
            columns = batch.columns[:kept]
            columns[at] = pa.array(texts, kind)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return marked.mapInArrow(run, docs.schema)
