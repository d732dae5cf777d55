"""Stored indexes whose parts have bounds, so that a search reads only the parts that can matter; results are exact.

A part is a set of rows with an upper bound of their scores for any question. A search scores the parts of the highest
bounds first; the k-th best score found there is a floor, and every part whose bound is below it is left unread. Two indexes are built that way:

* postings of sparse vectors: a row for each (part of the documents, term) with its postings and the greatest weight among them;
* cells of dense vectors: rows lie with the nearest of some centres, and the cell's radius bounds every dot product in it.

Both are folders of Parquet, sorted by what a search filters on; bounds are columns of their own, read without the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.vector import dot, sparse_index, top_k, vector

#: Documents of a part of the postings, about; centres of cells, at most, and vectors that the centres are chosen from. Parts that a search scores first.
PART_DOCS, CELLS, SAMPLED, FIRST = 1_024, 1_024, 20_000, 8


@dataclass
class Read:
    """What a search read: parts and rows, of all that could matter."""

    parts: int
    parts_read: int
    rows: int
    rows_read: int


def pruned_top_k(bounds: DataFrame, scored: Callable[[DataFrame], DataFrame], k: int, first: int = FIRST) -> tuple[DataFrame, Read]:
    """The ``k`` best (id, score, rank) of all parts, and what was read, by bounds (part, bound, rows).

    ``scored`` gives (id, score) of the rows of some parts, given as a table (part). Of the parts only the few best and counts come to the driver.
    """
    total = bounds.agg(F.count("*").alias("parts"), F.sum("rows").alias("rows")).first()
    floor, taken = None, first
    while floor is None and total.parts:
        top = bounds.orderBy(F.col("bound").desc(), "part").limit(taken).select("part")
        best = scored(top).orderBy(F.col("score").desc()).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("floor")).first()
        if best.n == k:
            floor = best.floor
        elif taken >= total.parts:
            break
        taken *= 4
    # Parts of an equal bound may hold an equal score with a smaller id. A bound may be off by rounding.
    wanted = bounds if floor is None else bounds.where(F.col("bound") >= F.lit(floor) - F.abs(F.lit(floor)) * 1e-9 - 1e-12)
    read = wanted.agg(F.count("*").alias("parts"), F.sum("rows").alias("rows")).first()
    return top_k(scored(wanted.select("part")), k), Read(total.parts, read.parts, total.rows or 0, read.rows or 0)


# Sparse


def store_postings(docs: DataFrame, id_col: str, text_col: str, folder: str, part_docs: int = PART_DOCS) -> None:
    """Writes the postings of all documents: (idx, part, most, rows, ids, ws), sorted by term, so that a search's terms are found by the file's own statistics."""
    parts = max(1, -(-docs.count() // part_docs))
    rows = sparse_index(docs, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    lists = rows.groupBy("idx", "part").agg(F.max("w").alias("most"), F.count("*").alias("rows"), F.sort_array(F.collect_list(F.struct("id", "w"))).alias("p"))
    each = lists.select("idx", "part", "most", "rows", F.col("p.id").alias("ids"), F.col("p.w").alias("ws"))
    each.repartitionByRange("idx", "part").sortWithinPartitions("idx", "part").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")


def sparse_search(spark: SparkSession, folder: str, terms: DataFrame, k: int) -> tuple[DataFrame, Read]:
    """The ``k`` best documents by dot product with a question's terms (idx, w), weights not being negative, and what was read of its terms' postings.

    The terms are few: those of one question.
    """
    asked = {r.idx: r.w for r in terms.collect()}
    mine = spark.read.parquet(f"{folder}/postings").where(F.col("idx").isin(*asked) if asked else F.lit(False))
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in asked.items() for x in pair)), F.col("idx")) if asked else F.lit(0.0)
    bounds = mine.groupBy("part").agg(F.sum(F.col("most") * weight).alias("bound"), F.sum("rows").alias("rows"))

    def scored(parts: DataFrame) -> DataFrame:
        hits = mine.join(parts, "part", "left_semi").select(F.explode(F.arrays_zip("ids", "ws")).alias("h"), weight.alias("qw"))
        return hits.groupBy(F.col("h.ids").alias("id")).agg(F.sum(F.col("h.ws") * F.col("qw")).alias("score"))

    return pruned_top_k(bounds, scored, k)


# Dense


def _centres(vectors: DataFrame, id_col: str, vector_col: str, cells: int) -> np.ndarray:
    """At most ``cells`` centres: vectors of a bounded sample, in order of a hash, moved once to the mean of those nearest to them."""
    sample = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLED).select(F.col(vector_col).cast("array<double>").alias("v"))
    rows = np.array([r.v for r in sample.collect()], np.float64)
    if not len(rows):
        return rows.reshape(0, 0)
    centres = rows[: max(1, min(cells, len(rows) // 4 or 1))]
    near = _nearest(rows, centres)[0]
    n = np.bincount(near, minlength=len(centres))
    sums = np.zeros_like(centres)
    np.add.at(sums, near, rows)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance computed plainly."""
    near = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(axis=1))


def store_cells(vectors: DataFrame, id_col: str, vector_col: str, folder: str, cells: int = CELLS) -> None:
    """Writes all vectors with their cell, sorted by it, and the cells (part, centre, radius, rows).

    Centres come from a bounded sample and are at most ``cells``; every vector is indexed. Null vectors take no part.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("values"))
    centres = _centres(vectors, id_col, vector_col, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near, far = _nearest(flat, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], names=["id", "values", "part", "far"])

    placed = rows.mapInArrow(place, f"id {kind}, values array<double>, part bigint, far double")
    placed.repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/vectors")
    spark = vectors.sparkSession
    found = spark.read.parquet(f"{folder}/vectors").groupBy("part").agg(F.max("far").alias("radius"), F.count("*").alias("rows"))
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "part bigint, centre array<double>")  # at most ``cells``
    found.join(F.broadcast(named), "part").write.parquet(f"{folder}/cells")


def dense_search(spark: SparkSession, folder: str, query: list[float], k: int) -> tuple[DataFrame, Read]:
    """The ``k`` best vectors by dot product with a query, and what was read: no dot product in a cell is over its centre's plus the radius times the query's length."""
    rows, cells = spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/cells")
    length = float(np.linalg.norm(query))
    asked = vector(query)
    bounds = cells.select("part", (dot(F.col("centre"), asked) + F.col("radius") * length * (1 + 1e-9) + 1e-9).alias("bound"), "rows")

    def scored(parts: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(parts), "part", "left_semi").select("id", dot(F.col("values"), asked).alias("score"))

    return pruned_top_k(bounds, scored, k)
