from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph, load
from ledgerlens.sources import tables
from ledgerlens.sources.tables import Conflict, Table

ROWS = "k string, v int, note string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i, None) for i in range(300)] + [(None, -1, "none")], ROWS)
    return Table.create(df, str(tmp_path / "t"), ["k"], buckets=16)


def test_an_upsert_touches_its_buckets_only(spark, table, tmp_path):
    before = files(tmp_path)
    new = spark.createDataFrame([("k3", 1000, "a"), ("k3", 1001, "b"), ("new", 5, None), (None, -2, "x")], ROWS)
    done = table.upsert(new, order="v")
    assert done.number == 1 and len(done.touched) <= 3
    after = files(tmp_path)
    assert all(after[p] == t for p, t in before.items())  # what is there stays as it is
    written = {p.split("_bucket=")[1].split("/")[0] for p in set(after) - set(before)}
    assert written == {str(b) for b in done.touched}
    want = {f"k{i}": (f"k{i}", i, None) for i in range(300)} | {"k3": ("k3", 1001, "b"), "new": ("new", 5, None), None: (None, -2, "x")}
    assert rows_of(table.read()) == sorted(want.values(), key=str)
    # Read anew by its folder, and as it was.
    again = Table(spark, table.folder)
    assert rows_of(again.read()) == rows_of(table.read()) and again.read(0).count() == 301
    assert rows_of(again.lookup(spark.createDataFrame([("k3",), ("k9",), ("zzz",)], "k string"))) == [("k3", 1001, "b"), ("k9", 9, None)]


def test_a_failure_before_the_commit_leaves_the_old_state(spark, table, monkeypatch):
    before = rows_of(table.read())

    def fail(self, commit):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", fail)
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([("k1", 9, None)], ROWS))
    assert rows_of(table.read()) == before and table.numbers() == [0]
    with pytest.raises(Exception, match="boom"):
        table.change(spark.createDataFrame([("k1", 9, None)], ROWS), lambda old, new: old.withColumn("v", F.expr("CAST(raise_error('boom') AS INT)")))
    assert rows_of(table.read()) == before
    assert table.upsert(spark.createDataFrame([("k1", 9, None)], ROWS)).number == 1
    assert table.clean() > 0 and table.read().where("k = 'k1'").first().v == 9 and table.numbers() == [1]


def test_of_two_changes_at_once_one_is_refused(spark, table):
    new = spark.createDataFrame([("k1", 9, None)], ROWS)

    def late(old, rows):
        Table(spark, table.folder).upsert(spark.createDataFrame([("k2", 8, None)], ROWS))
        return load.upsert(old, rows, ["k"])

    with pytest.raises(Conflict):
        table.change(new, late)
    assert {r.k: r.v for r in table.read().where("k IN ('k1', 'k2')").collect()} == {"k1": 1, "k2": 8}
    with pytest.raises(ValueError, match="left their buckets"):
        table.change(new, lambda old, rows: old.withColumn("k", F.concat("k", F.lit("-moved"))))


def test_deletes_replacements_and_empty_changes(spark, table):
    assert table.upsert(spark.createDataFrame([], ROWS)).number == 0
    table.delete(spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string"))
    assert rows_of(table.read()) == [(None, -1, "none")]
    table.replace(spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 3, None)], ROWS))
    table.replace(spark.createDataFrame([("a", 7, None)], ROWS))
    assert rows_of(table.read()) == [("a", 7, None), ("b", 3, None), (None, -1, "none")]
    empty = Table.create(spark.createDataFrame([], ROWS), f"{table.folder}-empty", ["k"], 4)
    assert empty.read().count() == 0 and empty.upsert(spark.createDataFrame([("a", 1, None)], ROWS)).number == 1 and empty.read().count() == 1
    with pytest.raises(Conflict):
        Table.create(spark.createDataFrame([], ROWS), empty.folder, ["k"], 4)


def test_entities_and_documents_are_merged_by_bucket(spark, tmp_path):
    kind = "type string, text string, mention_count long, source_document string, confidence double"
    found = [("Org", f"e{i % 40}", f"d{i}", 0.5 + i / 1000) for i in range(200)]
    df = spark.createDataFrame(found, "type string, text string, source_document string, confidence double")
    t = Table.create(spark.createDataFrame([], kind), str(tmp_path / "e"), ["type", "text"], 8)
    for k in range(4):
        t.change(df.where(F.substring("source_document", 2, 9).cast("int") % 4 == k), graph.merged_entities)
    assert {r.text: r.mention_count for r in t.read().collect()} == {f"e{i}": 5 for i in range(40)}
    docs = Table.create(spark.createDataFrame([("a", "t", 1, None)], "document_id string, title string, created_at int, updated_at int"), str(tmp_path / "d"), ["document_id"], 8)
    docs.change(spark.createDataFrame([("a", "u"), ("b", "v")], "document_id string, title string"), lambda old, new: graph.merged_documents(old, new, F.lit(5)))
    assert rows_of(docs.read()) == [("a", "u", 1, 5), ("b", "v", 5, None)]


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    t, want = Table.create(spark.createDataFrame([], ROWS), str(tmp_path / "r"), ["k"], 5), {}
    for _ in range(6):
        rows = {f"k{rng.randrange(30)}": (rng.randrange(100), rng.choice(["x", None])) for _ in range(8)}
        if rng.random() < 0.3 and want:
            t.delete(spark.createDataFrame([(k,) for k in rows], "k string"))
            for k in rows:
                want.pop(k, None)
        else:
            t.upsert(spark.createDataFrame([(k, *v) for k, v in rows.items()], ROWS))
            want |= rows
    assert rows_of(t.read()) == sorted(((k, *v) for k, v in want.items()), key=str)
    assert tables.BUCKETS > 1
