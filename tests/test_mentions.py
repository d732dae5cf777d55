from __future__ import annotations

import random

from ledgerlens.operators import graph

EDGES = "document_id bigint, entity_id bigint, page int"


def test_merged_mentions_are_those_of_a_plain_union(spark):
    """Copies, nulls, entities of several texts and of none, texts of many entities; parted and whole."""
    rng = random.Random(5)
    some = lambda *values: rng.choice(values)
    entities = [(some(None, *range(12)), some(None, "a", "a", "b", "c")) for _ in range(30)]
    mentions = [(some(None, 1, 2, 3), some(None, *range(12), 77), some(None, 1, 2)) for _ in range(60)]
    found = [(some(None, 1, 2, 3), some(None, "a", "b", "d"), some(None, 1, 2)) for _ in range(15)]
    want = set(mentions) | {(d, e, p) for d, t, p in found for e, own in entities if t is not None and t == own}
    tables = spark.createDataFrame(mentions, EDGES), spark.createDataFrame(entities, "entity_id bigint, text string"), spark.createDataFrame(found, "document_id bigint, text string, page int")
    got = [tuple(r) for r in graph.merged_mentions(*tables).collect()]
    assert len(got) == len(want) and set(got) == want
    finds, texts = tables[2].where("text IS NOT NULL").distinct(), tables[1].where("text IS NOT NULL").distinct()
    made = {block: sorted(map(str, graph._crossed(finds, texts, block).collect())) for block in (1, 3, 1000)}
    assert made[1] == made[3] == made[1000] and made[1]


def test_new_mentions_are_not_shuffled(spark):
    """A thousand entities of one text, found a thousand times: a million new edges, none of which is written to a shuffle."""
    entities = spark.range(1000).selectExpr("id AS entity_id", "'x' AS text")
    mentions = spark.range(10).selectExpr("id AS document_id", "id AS entity_id", "1 AS page")
    found = spark.range(1000).selectExpr("id AS document_id", "'x' AS text", "1 AS page")
    merged = graph.merged_mentions(mentions, entities, found)
    assert merged.count() == 1_000_000
    top = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Union")


def test_rows_dealt_grow_with_the_tables(spark, monkeypatch):
    """Four times the finds and entities of one text are sixteen times the edges, but four times the rows that are shuffled to make them; blocks have a largest size."""
    def rows(n):
        found, texts = spark.range(n).selectExpr("id AS document_id", "'x' AS text", "1 AS page"), spark.range(n).selectExpr("id AS entity_id", "'x' AS text")
        return [side.count() for side in graph._dealt(found, texts)]

    small, large = rows(50_000), rows(200_000)
    assert all(4 * a == b for a, b in zip(small, large, strict=True))
    monkeypatch.setattr(graph, "BLOCK", 1)
    monkeypatch.setattr(graph, "LARGEST", 10)
    assert rows(1000) == [100_000, 100_000]


def test_known_mentions_are_shuffled_once(spark):
    """Of pages without finds they are shuffled by page, and neither by entity nor again by page."""
    entities = spark.range(200).selectExpr("id AS entity_id", "concat('t', id) AS text")
    mentions = spark.range(40_000).selectExpr("id DIV 4 AS document_id", "id % 200 AS entity_id", "id % 4 AS page")
    found = spark.range(10).selectExpr("id AS document_id", "concat('t', id) AS text", "id % 4 AS page")
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {tuple(r) for r in graph.merged_mentions(mentions, entities, found).collect()}
        rows = sum(n for stage, n in written().items() if stage not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(i // 4, i % 200, i % 4) for i in range(40_000)} | {(i, i, i % 4) for i in range(10)}
    assert 40_000 <= rows < 50_000


def test_known_mentions_meet_finds_of_other_types(spark):
    """A known edge that is found again stays one, whether its ids and pages are ints or bigints, null or not."""
    entities = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], "entity_id bigint, text string")
    rows = [(1, 1, 1), (1, 1, None), (None, 1, 1), (None, None, 1), (1, 2, 1), (2, 9, 1), (2, 9, 1)]
    mentions = spark.createDataFrame(rows, "document_id bigint, entity_id int, page bigint")
    found = spark.createDataFrame([(1, "a", 1), (1, "a", None), (None, "a", 1), (None, "b", None)], "document_id int, text string, page int")
    want = {*rows, (1, None, 1), (1, None, None), (None, 2, None)}
    got = [tuple(r) for r in graph.merged_mentions(mentions, entities, found).collect()]
    assert len(got) == len(want) and set(got) == want


def test_joins_of_two_hops_keep_their_number_of_tasks(spark):
    """Few bytes in a join's partitions make many rows, so adaptive execution isn't to put these together."""
    mentions = spark.range(4000).selectExpr("id AS edge_id", "id div 4 AS document_id", "pmod(id * 7, 500) AS entity_id", "1 AS page")
    found = graph._two_away(mentions, mentions.where("entity_id < 8"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 6
    rows = {tuple(r) for r in mentions.select("document_id", "entity_id", "edge_id").collect()}
    by_document, by_entity = {}, {}
    for d, e, x in rows:
        by_document.setdefault(d, set()).add((e, x))
        by_entity.setdefault(e, set()).add((d, x))
    want = {(c, d2) for d, a, _ in rows if a < 8 for b, x in by_document[d] if b != a for d2, y in by_entity[b] if y != x for c, _ in by_document[d2] if c not in (a, b)}
    counts = {}
    for c, _ in want:
        counts[c] = counts.get(c, 0) + 1
    assert {tuple(r) for r in found.collect()} == set(counts.items()) and counts
