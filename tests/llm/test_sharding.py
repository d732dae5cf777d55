from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import sharding


def test_growth_moves_rows_only_into_the_new_shard(spark):
    texts = [None, "", "é", "same", "same"] + [f"t{i}" for i in range(3000)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "x", 1), (5, "t0", 1), (5, "t0", 1)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, slot int"), sharding.tree_of(40)).collect()
    assert len(got) == len(rows)
    assert all(r.grown_shard in (r.shard, 40) for r in got)
    assert 20 < sum(r.grown_shard == 40 for r in got) < 150
    assert {r.shard for r in got} == set(range(40))
    for s in range(40):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_changed_weight_moves_rows_only_through_its_subtree(spark):
    tree = sharding.tree_of(16)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["r0"]["k1"][5] = 3.0
    ids = spark.range(4000)
    rows = ids.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(r.b in range(8) for r in moved)
    assert all(r.b in range(4, 8) for r in moved if r.a in range(8)) and all(r.b == 5 for r in moved if r.a in range(4, 8))


def test_empty(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), sharding.tree_of(3)).count() == 0


def test_written_shards(spark, tmp_path):
    tree = sharding.tree_of(5)
    sharding.write_shards(spark.range(100).withColumnRenamed("id", "doc_id"), tree, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.where(F.col("_shard") != sharding.shard_of(F.col("doc_id"), tree)).count() == 0
