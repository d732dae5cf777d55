"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint sums up a text's 3-word shingles in 64 bits; texts whose fingerprints
differ in at most two bits are linked, and components of links are groups of near
copies. Fingerprints are cut into four blocks. Two differing bits spoil two blocks
at most, so each close pair agrees on two whole blocks: fingerprints that share a
pair of blocks are joined, and the Hamming distance decides.

Copies cost nothing, as only distinct fingerprints are joined. A block pair that
more than ``bucket`` distinct fingerprints share isn't joined with itself, which
would be quadratic. Its members are instead split on: each meets the others at the
65 values that differ from it in one bit or none. Two fingerprints meet at such a
value exactly if they differ in two bits or fewer, and a value has at most 65 of
them, so this is exact and linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, connected_components, kept, partitions, spread_join, stored

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 2, 4


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; other columns are left behind, whatever their names."""
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(pairs.dtypes)["doc_id"]
    return arrow_rows(pairs, lambda ids, texts: {"doc_id": ids, "fp": [fingerprint(t) for t in texts]}, f"doc_id {kind}, fp bigint")


def _masks() -> list[int]:
    width = 64 // BLOCKS
    blocks = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    kept = [sum(c) for c in combinations(blocks, BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def close_pairs(fps: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``: all close pairs of blocks with up to
    ``bucket`` members, and for larger blocks enough of them to connect whatever is connected."""
    keys = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()))).alias("block", "key"))
    shared = keys.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread_join(keys, shared, ["block", "key"], sizes=shared), "simhash-members")
    small = members.where(F.col("n") <= bucket)
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["block", "key"])
        .where("x.fp < y.fp")
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= DISTANCE)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    meeting = crowded.repartition(partitions(fps.sparkSession), "fp").select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    first = F.min("fp").over(Window.partitionBy("value"))
    hubs = meeting.select(first.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return pairs.union(hubs).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = 64) -> DataFrame:
    """Groups of near copies: (doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with the same text share a
    fingerprint, thus a group. ``component_id`` is the group's smallest non-null id. An
    empty table gives an empty result.
    """
    fps = kept(fingerprints(docs, id_col, text_col))
    classes = kept(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(close_pairs(classes.select("fp"), bucket), "simhash").withColumnRenamed("node", "fp")
    named = classes.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = spread_join(named, least, ["component"]).select("fp", "component_id")
    return spread_join(fps, groups, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
