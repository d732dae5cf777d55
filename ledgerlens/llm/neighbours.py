"""Approximate nearest neighbours by collision counting.

Vectors are dealt to blocks of bounded size. A block's index has, for each of
``PROJECTIONS`` lines, its vectors' places on the line as one sorted array, and which vector stands at each. The lines are random
rotations of the axes, so that together they lose nothing of a distance, and counts vary less than on independent lines.
A query opens a window around its own place on each line and widens all of them step
by step, the same arrays serving every radius (virtual rehashing). A step counts only the vectors that enter a window by it, once for each line.
Those that collide on at least ``THRESHOLD`` of the lines are
verified, that is, their distance is computed. It ends when the windows reach ``REACH`` times the ``k``-th best distance
found to either side, or hold everything. All vectors of the block are within reach, none is dropped.

Each block is read once, its vectors first and then all queries, which stream past its index. It finds its own ``k`` best for each
query; the best of all blocks are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import partitions, small_batches, stored

PROJECTIONS, THRESHOLD, REACH, WIDEN, SEED = 128, 0.72, 1.2, 1.3, 7
#: Vectors of a block whose nearest ones tell how wide windows begin: at this share of what such distances ask for.
PROBES, BEGIN = 16, 0.6
BLOCK = 8_192


def lines(dim: int, count: int) -> np.ndarray:
    """``count`` directions, orthogonal within each ``dim`` of them, as long as random normal ones."""
    rng = np.random.default_rng(SEED)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(turns, axis=1)[:, :count] * np.sqrt(dim)


class CollisionIndex:
    """Sorted projections of one block: all lines in one row, each far from the next, so that all windows are looked up at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.lines = lines(vectors.shape[1], projections)
        places = (vectors @ self.lines).T
        order = np.argsort(places, axis=1)
        self.least, self.most = float(places.min()), float(places.max())
        self.apart = np.arange(projections) * 4 * (self.most - self.least + 1)
        self.places = (np.take_along_axis(places, order, axis=1) + self.apart[:, None]).ravel()
        self.order = order.astype(np.int32).ravel()
        self.begin = np.arange(projections) * n
        some = vectors[:: max(1, n // PROBES)][:PROBES]
        near = [float(np.partition(((vectors - v) ** 2).sum(axis=1), min(10, n - 1))[min(10, n - 1)]) for v in some]
        self.start = max(BEGIN * REACH * float(np.sqrt(np.median(near))), 1e-12)

    def search(self, own: int, vector: np.ndarray, k: int, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the ``k`` nearest found, ties to smaller ids, without the id ``own``; and how many were verified."""
        n, m = len(self.ids), len(self.apart)
        need, wide = int(np.ceil(threshold * m)), self.most - self.least + 1
        # Beyond a line's ends a place counts as at most a line's length away; its window is as wide as ever.
        told = vector @ self.lines
        here = np.clip(told, self.least - wide, self.most + wide) + self.apart
        far = np.abs(here - self.apart - told)
        ends = self.begin + n
        low = high = np.clip(self.places.searchsorted(here), self.begin, ends)
        counts, done = np.zeros(n, np.int64), self.ids == own
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        half = self.start
        while True:
            reach = np.clip(half - far, 0, 2 * wide)
            until = self.places.searchsorted(np.concatenate([here - reach, here + reach]), "left")
            until[m:] = self.places.searchsorted(here + reach, "right")
            left, right = np.minimum(np.clip(until[:m], self.begin, ends), low), np.maximum(np.clip(until[m:], self.begin, ends), high)
            # What enters: on each line the places before and after the window so far.
            size = np.concatenate([low - left, right - high])
            stop = np.cumsum(size)
            entered = np.repeat(np.concatenate([left, high]) - stop + size, size) + np.arange(stop[-1])
            counts += np.bincount(self.order[entered], minlength=n)
            low, high = left, right
            ripe = np.flatnonzero((counts >= need) & ~done)
            if len(ripe):
                done[ripe] = True
                found = np.concatenate([found, ripe])
                distance = np.concatenate([distance, np.sqrt(((self.vectors[ripe] - vector) ** 2).sum(axis=1))])
                if len(found) > k:
                    best = np.lexsort((self.ids[found], distance))[:k]
                    found, distance = found[best], distance[best]
            enough = REACH * distance.max() if len(found) >= k else np.inf
            if half >= enough or int((high - low).min()) == n:
                best = np.lexsort((self.ids[found], distance))
                return self.ids[found[best]], distance[best], int(done.sum())
            half = min(half * WIDEN, enough)


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of vectors that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    good = rows.select(F.col(id_col).alias("id"), v.alias("vector")).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return good.groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, by Euclidean distance.

    Vectors that are null, zero, or hold nulls or non-finite numbers take no part. Of rows with one id the
    least vector stands for all. A query isn't its own neighbour; if fewer than ``k`` others are there, all are returned.
    Only vectors of the query's length are compared with it. Each vector goes to one block, each query to all of them.
    """
    spark = base.sparkSession
    small_batches(spark)
    good = stored(_usable(base, id_col, vector_col), "vectors")
    asked = _usable(queries, id_col, vector_col)
    blocks = max(1, -(-good.count() // BLOCK))
    dim, kind = F.size("vector").alias("dim"), lambda n: F.lit(n).alias("kind")
    left = good.select(dim, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), kind(0), F.col("id").cast("bigint").alias("id"), "vector")
    right = asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), kind(1), F.col("id").cast("bigint").alias("id"), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                part, key = batch.slice(at, to - at), tuple(keys[at, :2])
                if key != now:
                    now, index, ids, vectors = key, None, [], []
                mine = part.column(3).to_numpy(), _matrix(part.column(4))
                if keys[at, 2] == 0:
                    ids.append(mine[0])
                    vectors.append(mine[1])
                    continue
                if not ids:
                    continue
                index = index or CollisionIndex(np.concatenate(ids), np.concatenate(vectors))
                out = [(own, *index.search(own, vector, k)) for own, vector in zip(*mine, strict=True)]
                lengths = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine[0], lengths)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "vec_id", "score"])

    rows = left.union(right).repartition(partitions(spark), "dim", "block").sortWithinPartitions("dim", "block", "kind")
    found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
