from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlens.operators import graph, vector
from ledgerlens.plans import retrieve
from ledgerlens.providers import HashedTerms, parsed_quotes, parsed_results, quotes, web_results


def test_fusion_example(spark):
    lists = spark.createDataFrame([("dense", 0, 1, "c1"), ("dense", 0, 2, "c2"), ("bm25", 1, 1, "c2"), ("bm25", 1, 2, "c3"), ("bm25", 1, 3, None)], "label string, list int, rank int, id string")
    rows = vector.rrf(lists).orderBy("pos").collect()
    assert [r.id for r in rows] == ["c2", "c1", "c3"] and rows[0].sources == ["dense", "bm25"]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    # An empty first list doesn't give its label to the next one.
    alone = vector.rrf(lists.where("list = 1")).orderBy("pos").collect()
    assert [r.sources for r in alone] == [["bm25"], ["bm25"]]
    said = vector.rrf(lists).orderBy("pos").select(vector.rrf_explanation(F.col("rrf_score"), F.col("sources")).alias("x")).first().x
    assert said.startswith("RRF score 0.0325 from dense+bm25")


def test_fusion_equals_plain(spark):
    rng = random.Random(1)
    rows = [(f"l{k}", k, r, rng.choice([None, *"abcdefghij"])) for k in range(4) for r in range(1, 12)]
    want, first = {}, {}
    for label, k, r, i in rows:
        if i:
            want[i] = want.get(i, 0) + 1 / (60 + r)
            first.setdefault(i, (k, r))
    got = vector.rrf(spark.createDataFrame(rows, "label string, list int, rank int, id string")).orderBy("pos").collect()
    assert {r.id: pytest.approx(r.rrf_score) for r in got} == want
    assert [r.id for r in got] == sorted(want, key=lambda i: (-round(want[i], 12), first[i]))


def test_page_boost(spark):
    rows = spark.createDataFrame([("a", "d1", 1, 0.5), ("b", "d1", 9, 0.5), ("c", "d1", None, 0.5), ("d", "d2", 1, 0.5)], "id string, document_id string, start_page int, rrf_score double").withColumn("sources", F.array(F.lit("dense")))
    evidence = spark.createDataFrame([("d1", [1, 2]), ("d1", [2])], "document_id string, pages array<int>")
    score = lambda df: {r.id: (round(r.rrf_score, 3), len(r.sources)) for r in df.collect()}
    assert score(vector.graph_boost(rows, evidence)) == {"a": (0.6, 2), "b": (0.5, 1), "c": (0.6, 2), "d": (0.5, 1)}
    assert score(vector.graph_boost(rows, evidence, by_page=False))["b"] == (0.6, 2)


def test_index_changes(spark):
    index = spark.createDataFrame([("a", "d1", [1.0, 0.0]), ("b", "d2", [0.0, 1.0])], "id string, document_id string, values array<double>")
    new = spark.createDataFrame([("c", "d1", [1.0, 1.0]), ("bad", "d1", [1.0])], "id string, document_id string, values array<double>")
    after = vector.upsert_document(index, vector.storable(new, ["document_id"], 2))
    assert sorted(r.id for r in after.collect()) == ["b", "c"]
    assert sorted(r.id for r in vector.upsert_document(index, new.limit(0)).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        vector.delete_where(index, {"document_id": None})
    assert vector.search_filters("aapl", "10K", None) == {"ticker": "AAPL", "document_type": "10k"}
    big = new.withColumn("text", F.repeat(F.lit("x"), 40_000))
    assert vector.storable(big, ["text"], 2).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {0: "Net revenue rose in the data center segment.", 1: "Risk of supply shortage in Asia. " * 20, 2: "The board met.", 3: "Data center revenue fell. Other sentences say nothing here."}
    e = HashedTerms(64)
    d = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    chunks = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 3).alias("parent_id"), F.concat(F.lit("D"), "doc_id").alias("document_id"), e.column(F.col("text")).alias("values"), "text", F.col("text").alias("parent_text"), F.lit(1).alias("start_page"), F.lit("AAA").alias("ticker"))
    entities = spark.createDataFrame([(1, "Data Center", "Concept", 2), (2, "Asia", "Location", 1)], "entity_id long, text string, type string, mention_count long")
    mentions = spark.createDataFrame([(1, "D3", 1, 1), (2, "D1", 2, 1)], "edge_id long, document_id string, entity_id long, page int")
    return retrieve.Corpus(chunks, vector.sparse_index(d, "doc_id", "text"), entities, mentions), e


def test_whole_retrieval(corpus):
    c, e = corpus
    r = retrieve.Retriever(c, e)
    rows = r.retrieve("data center revenue", names=["data center"], filters={"ticker": "AAA"}).collect()
    assert rows[0].id == 3 and "kg_boost" in rows[0].sources and len({x.parent_id for x in rows}) == len(rows) and not r.failed
    assert rows[0].compressed_text == "Data center revenue fell. Other sentences say nothing here."
    long = next(x for x in rows if x.id == 1)
    assert long.compression_skipped and long.compressed_text == long.parent_text
    plain = r.retrieve("data center revenue", rerank=False, compress=False, use_graph=False, top_k=2)
    assert plain.count() == 2 and plain.where("relevance_score IS NOT NULL").count() == 0
    shown = retrieve.formatted(r.retrieve("data center revenue")).collect()
    assert shown[0].shown.startswith("Source: AAA") and "Relevance: " in shown[0].shown and "Matched: " in shown[0].shown


def test_failed_stages_are_named(corpus):
    c, e = corpus

    r = retrieve.Retriever(c, e)

    def broken(*_):
        raise OSError("the graph is down")

    r.evidence = broken
    assert r.retrieve("revenue").count() > 0 and r.failed == ["kg"]
    # A column that isn't there is a fault of the program.
    misspelt = retrieve.Retriever(retrieve.Corpus(c.chunks, c.sparse.drop("idx"), c.entities, c.mentions), e)
    with pytest.raises(AnalysisException):
        misspelt.retrieve("revenue")
    with pytest.raises(AnalysisException):
        misspelt.search("revenue")


def test_entities_come_from_the_question(corpus):
    c, e = corpus
    spark = c.chunks.sparkSession
    patterns = spark.createDataFrame([("CONCEPT", "data center", "token"), ("GPE", "Asia", "phrase")], "label string, pattern string, kind string")
    r = retrieve.Retriever(retrieve.Corpus(c.chunks, c.sparse, c.entities, c.mentions, patterns), e)
    rows = r.retrieve("How did data center revenue do", filters={"ticker": "AAA"}).collect()
    assert rows[0].id == 3 and "kg_boost" in rows[0].sources and not r.failed
    assert all("kg_boost" not in x.sources for x in r.retrieve("How did revenue do").collect())
    found = {x.document_id: x for x in r.evidence("data center in Asia", None, False).collect()}
    assert (found["D3"].matched_entity, found["D3"].entity_type, found["D3"].pages) == ("data center", "Concept", [1]) and found["D1"].matched_entity == "Asia"


def test_search_falls_back_to_dense_when_hybrid_fails_as_it_runs(corpus):
    c, e = corpus
    good = retrieve.Retriever(c, e).search("data center revenue", 2)
    assert good.notice is None and good.rows[0]["parent_id"] == 0 and len(good.rows) == 2
    broken = c.sparse.withColumn("w", F.expr("CAST(raise_error('index is down') AS DOUBLE)"))
    assert set(broken.columns) == set(c.sparse.columns)
    down = retrieve.Retriever(retrieve.Corpus(c.chunks, broken, c.entities, c.mentions), e)
    answer = down.search("data center revenue", 2)
    assert answer.notice.startswith("Dense search only") and len(answer.rows) == 2
    assert [r["id"] for r in answer.rows] == [r["id"] for r in down.search("data center revenue", 2, hybrid=False).rows]


def test_models_are_replaceable(corpus):
    c, e = corpus
    r = retrieve.Retriever(c, e, reranker=lambda q, t: F.length(t).cast("double"), compressor=lambda q, t: F.upper(t))
    rows = r.retrieve("revenue", top_k=2).collect()
    assert rows[0].id == 1 and rows[0].compressed_text == rows[0].parent_text.upper()
    with pytest.raises(ZeroDivisionError):  # a fault of the program isn't hidden
        retrieve.Retriever(c, e, reranker=lambda q, t: 1 / 0).search("revenue")


def test_services(spark):
    assert [x.ticker for x in quotes(spark, ["aapl ", ""]).collect()] == ["AAPL"]
    with pytest.raises(ValueError):
        quotes(spark, [" "])
    raw = spark.createDataFrame([("A", 1.0, 0.1, 0.5, 3, 0)], "symbol string, price double, change double, changePercentage double, volume long, timestamp long")
    assert parsed_quotes(raw).first().timestamp == "1970-01-01T00:00:00+00:00"
    assert web_results(spark, "q", 0).count() == 1
    assert parsed_results(spark.createDataFrame([(None, "c", "u")] * 20, "title string, content string, url string"), 50).count() == 10


# The graph


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([(1, "Alpha", "Org", 3), (2, "alpha", "Person", 1), (3, "Beta", "Org", None), (4, "Gamma", "Org", 2), (5, "Lone", "Org", 1)], "entity_id long, text string, type string, mention_count long")
    m = spark.createDataFrame([(1, "d1", 1, 1), (2, "d1", 3, 2), (3, "d1", 3, None), (4, "d2", 3, 1), (5, "d2", 4, 1), (6, "d3", 2, 5)], "edge_id long, document_id string, entity_id long, page int")
    return e, m


def test_lookups(small, spark):
    e, m = small
    ids = lambda df, c="document_id": [r[c] for r in df.collect()]
    assert ids(graph.documents_mentioning(e, m, "ALPHA")) == ["d1", "d3"]
    assert ids(graph.documents_mentioning(e, m, "alpha", "Person")) == ["d3"]
    assert ids(graph.documents_mentioning(e, m, "a%a", fuzzy=True)) == []
    assert [(r.document_id, r.pages) for r in graph.pages_mentioning(e, m, "beta").collect()] == [("d1", [2]), ("d2", [1])]
    assert ids(graph.related(e, m, "alpha"), "text") == ["Beta"]
    assert {r.text: r.shared_docs for r in graph.related(e, m, "alpha", hops=2).collect()} == {"Gamma": 1}
    assert ids(graph.search(e, "a"), "text") == ["Alpha", "Gamma", "Beta", "alpha"]
    assert graph.stats(e, m.limit(0), spark.createDataFrame([("d1",)], "document_id string")).first().nodes == 6
    assert graph.document_exists(m, "d1") and not graph.document_exists(m, "d9")
    assert [r.path_length for r in graph.path_length(e, m, "alpha", "gamma").collect()] == [4]
    assert graph.path_length(e, m, "alpha", "gamma", hops=1).count() == 0 and graph.path_length(e, m, "alpha", "lone").count() == 0
    assert graph.path_length(e, m, "alpha", "Alpha").first().path_length == 0


def test_path_nodes(small):
    e, m = small
    path = lambda *a, **k: [(r.kind, r.node) for r in graph.shortest_path(e, m, *a, **k).orderBy("position").collect()]
    assert path("alpha", "gamma") == [("entity", "1"), ("document", "d1"), ("entity", "3"), ("document", "d2"), ("entity", "4")]
    assert path("beta", "gamma") == [("entity", "3"), ("document", "d2"), ("entity", "4")]
    assert path("beta", "Beta") == [("entity", "3")]
    assert path("alpha", "gamma", hops=1) == [] and path("alpha", "lone") == []


def test_one_document_serves_both_middle_edges(spark):
    """Alpha and Gamma share only d1, which mentions the middle on two pages: two edges, so a path of four."""
    e = spark.createDataFrame([(1, "Alpha", "Org", 1), (2, "Mid", "Org", 1), (3, "Gamma", "Org", 1)], "entity_id long, text string, type string, mention_count long")
    once = [(1, "d1", 1, 1), (2, "d1", 2, 1), (3, "d1", 3, 1)]
    schema = "edge_id long, document_id string, entity_id long, page int"
    assert graph.related(e, spark.createDataFrame(once, schema), "alpha", hops=2).count() == 0
    assert {r.text for r in graph.related(e, spark.createDataFrame([*once, (4, "d1", 2, 2)], schema), "alpha", hops=2).collect()} == {"Gamma"}


def test_merges(small, spark):
    e, _ = small
    known = e.select("type", "text", "mention_count", F.lit("s").alias("source_document"), F.lit(1.0).alias("confidence"))
    found = spark.createDataFrame([("Org", "Alpha", "x", 0.5), ("Org", "Alpha", "y", 0.9), ("Org", "New", "z", 0.7)], "type string, text string, source_document string, confidence double")
    got = {(r.type, r.text): (r.mention_count, r.source_document) for r in graph.merged_entities(known, found).collect()}
    assert got["Org", "Alpha"] == (5, "s") and got["Org", "New"] == (1, "z") and got["Person", "alpha"] == (1, "s")
    rows = spark.createDataFrame([("Acme", "Org", 0.5, 1), ("ACME", "Org", 0.9, 2), ("acme", "Org", 0.9, 3)], "text string, type string, confidence double, seq int")
    assert tuple(graph.merged_by_text(rows, ["seq"]).first()) == ("ACME", "Org", 0.9, 3)


def test_graph_search_keeps_first_evidence_and_all_pages(small):
    e, m = small
    spark = e.sparkSession
    asked = spark.createDataFrame([(0, "alpha", "Org"), (7, "GAMMA", "Org")], "seq int, text string, type string")
    got = {r.document_id: tuple(r)[1:] for r in graph.evidence_of(e, m, asked).collect()}
    assert got == {"d1": ("alpha", "Org", "direct_mention", None, None, [1]), "d3": ("alpha", "Org", "direct_mention", None, None, [5]), "d2": ("GAMMA", "Org", "direct_mention", None, None, [1])}
    near = {r.document_id: r for r in graph.evidence_of(e, m, asked.where("seq = 0"), near=True).collect()}
    assert (near["d2"].matched_entity, near["d2"].match_type, near["d2"].related_to, near["d2"].shared_docs) == ("Beta", "related_via", "alpha", 1)
    assert near["d1"].pages == [1, 2] and near["d1"].match_type == "direct_mention"
    assert graph.evidence_of(e, m, asked, limit=1).count() == 2 and graph.evidence_of(e, m, asked.limit(0), near=True).count() == 0
