"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks and racks have shards, each node weighing as
much as its shards. A row descends it: at each level every child draws
``-ln(u) / weight`` from a hash of the row's id and the child's path, and the least
draw wins, so a child gets its share of the weight. When a weight changes, rows move
only into or out of the subtrees above it: draws of all other children stay the same. A shard that is
added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import salts, stored

Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, rack: int = 4, racks: int = 2) -> Tree:
    """``shards`` shards of weight 1, ``rack`` in a rack and ``racks`` racks in a region."""
    tree: Tree = {}
    for s in range(shards):
        tree.setdefault(f"r{s // (rack * racks)}", {}).setdefault(f"k{s // rack % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: no other weight changes."""
    new = 1 + max((s for region in tree.values() for rack in region.values() for s in rack), default=-1)
    return {**tree, f"grown{new}": {"k0": {new: weight}}}


def _levels(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    below = {f"{r}/{k}": [(str(s), float(w)) for s, w in shards.items()] for r, racks in tree.items() for k, shards in racks.items()}
    total = lambda p: sum(w for _, w in below[p])
    below |= {r: [(k, total(f"{r}/{k}")) for k in racks] for r, racks in tree.items()}
    return below | {"": [(r, sum(w for _, w in below[r])) for r in tree]}


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) of each key: three draws, one for each level."""
    child = lambda c, w: F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight"))
    table = F.create_map(*(x for path, kids in _levels(tree).items() for x in (F.lit(path), F.array(*(child(c, w) for c, w in kids if w > 0)))))
    path = F.lit("")
    for level in range(3):
        at = path

        def draw(c: Column, at: Column = at) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, at, c["name"]), 11).cast("double") + 0.5) / float(1 << 53)
            return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

        best = F.array_min(F.transform(F.element_at(table, at), draw))["name"]
        path = best if level != 1 else F.concat(at, F.lit("/"), best)
    return path.cast("int")


def shard_rows(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot), one row for each row of ``docs``.

    Size is the text's UTF-8 bytes and 16 more; a null text has none and the CRC of an
    empty one. Null ids are hashed like any other value and share a shard. Slots count from 0 in each shard without gaps, by hash
    salt, id and CRC; rows that agree on all of these may swap slots. Each shard is
    numbered in parts, as many as the number of all rows asks for, so no task gets a whole shard of very many.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col("doc_id")
    rows = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown(tree)).alias("grown_shard"))
    rows = stored(rows, "sharded")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts(rows.count()))).cast("int"))
    counts = rows.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("shard", "_salt", before.alias("_base"))
    rank = F.row_number().over(Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.select("*", rank.alias("_rank"))
    return ranked.join(bases, ["shard", "_salt"]).select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_base") + F.col("_rank") - 1).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id") -> None:
    """Writes the rows as Parquet, one folder for each shard."""
    docs.withColumn("_shard", shard_of(F.col(id_col), tree)).write.partitionBy("_shard").parquet(path)
