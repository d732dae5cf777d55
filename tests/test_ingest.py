from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chunking, graph, load
from ledgerlens.plans import ingest
from ledgerlens.providers import HashedTerms
from ledgerlens.queries import ingest as queries
from ledgerlens.sources import documents as source
from ledgerlens.sources import quotes


def page(n, text, section=None, **more):
    return {"page_number": n, "text": text, "section": section, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("extracted")
    filing = {
        "document_id": "AAA_10K_2024", "document_type": "10k", "total_pages": 3, "metadata": {"company": "Alpha Inc", "ticker": None},
        "pages": [
            page(1, "Alpha makes chips. It sells them.", "Item 1", financial_metrics={"fiscal_year": 2024, "revenue": 10.0, "net_income": 1.0}, segment_data=[{"segment_name": "Chips", "revenue": 7.0, "fiscal_year": 2024}]),
            page(2, "  "),
            page(3, "Risks are many. " * 60, "Item 1A", financial_metrics={"fiscal_year": 2024, "revenue": 12.0, "net_income": None}, segment_data=[{"segment_name": "Chips", "revenue": 9.0, "fiscal_year": 2024}, {"segment_name": "Boards", "revenue": 1.0, "fiscal_year": 2024}], risk_factors=[{"title": "Supply", "severity": "HIGH"}, {"title": "Odd", "severity": "huge"}]),
        ],
    }
    news = {"document_id": "news_1", "document_type": "reference", "total_pages": 1, "metadata": {"source": "Wire", "headline": "Alpha rises", "publication_date": "2025-01-10", "source_type": "news"}, "pages": [page(1, "Alpha rose again.", headline="Alpha rises", key_claims=[{"claim": "It rose", "entities": []}], entities_mentioned=["B", "A"]), page(2, "More.", key_claims=[{"claim": "And again"}], entities_mentioned=["A"])]}
    for d in (filing, news):
        (at / f"{d['document_id']}.json").write_text(json.dumps(d))
    (at / "manifest.json").write_text("{}")
    (at / "BROKEN.json").write_text('{"document_id": ')
    (at / "AAA_10K_2024.pdf").write_bytes(b"%PDF one")
    return str(at)


def test_scan(spark, folder):
    rows = source.extracted(spark, folder)
    assert rows.count() == 3 and rows.where("broken IS NOT NULL").count() == 1
    assert {r.document_id for r in source.readable(rows).collect()} == {"AAA_10K_2024", "news_1"}
    assert source.extracted(spark, folder, "aaa").count() == 1
    one = source.files(spark, folder).first()
    assert (one.doc_id, one.doc_type, one.file_size_bytes) == ("AAA_10K_2024", "10k", 8) and len(one.file_hash) == 32
    assert source.manifest(spark, folder + "/none.json").count() == 0
    assert source.missing_tables(spark, ["surely_not_there"]) == ["surely_not_there"]


def test_metrics_tables(spark, folder):
    docs = source.readable(source.extracted(spark, folder))
    tables = ingest.metrics_tables(docs, spark.createDataFrame([(5, "AAA")], "id int, ticker string"))
    m = tables["financial_metrics"].first()
    assert (m.company_id, m.fiscal_year, float(m.revenue), float(m.net_income), m.gross_margin) == (5, 2024, 12.0, 1.0, None)
    assert {(r.segment_name, r.revenue, r.source_page) for r in tables["segment_revenue"].collect()} == {("Chips", 7.0, 1), ("Boards", 1.0, 3)}
    assert {(r.title, r.severity, r.page_number) for r in tables["risk_factors"].collect()} == {("Supply", "high", 3), ("Odd", None, 3)}
    refs = load.reference_documents(load.page_rows(docs.where("document_type = 'reference'"))).first()
    assert refs.headline == "Alpha rises" and [c.claim for c in refs.key_claims] == ["It rose", "And again"] and refs.entities_mentioned == ["A", "B"]


def test_index_build(spark, folder):
    docs = source.readable(source.extracted(spark, folder))
    records = ingest.vector_records(docs, HashedTerms(8), parent=120, child=40, overlap=8)
    rows = records.collect()
    filing = [r for r in rows if r.document_id == "AAA_10K_2024"]
    assert filing[0].text.startswith("[10-K Filing] [Alpha Inc (AAA)] [FY2024] [Item 1] [Page 1 of 3]\n\nAlpha makes")
    assert any(r.text.startswith("[news] [Wire] [2025-01-10] [Alpha rises]\n\nAlpha rose") for r in rows)
    assert all(len(r.values) == 8 and r.text.endswith(r.text_raw) and r.token_count > 0 for r in rows)
    assert sorted(r.child_index_in_document for r in filing) == list(range(len(filing)))
    manifest = spark.createDataFrame([("news_1", True, ingest.VERSION)], "doc_id string, indexed boolean, index_schema_version string")
    index, done = ingest.indexed(records.where("document_id = 'news_1'"), manifest, docs, parent=120, child=40, overlap=8)
    assert [r.doc_id for r in done.collect()] == ["AAA_10K_2024"]
    assert {r.document_id for r in index.select("document_id").distinct().collect()} == {"news_1", "AAA_10K_2024"}


def test_graph_build(spark, folder):
    docs = source.readable(source.extracted(spark, folder))
    entities, mentions = ingest.graph_of(docs, spark.createDataFrame([("ORG", "alpha", "token")], "label string, pattern string, kind string"))
    e = entities.first()
    assert (e.text, e.mention_count) == ("Alpha", 2) and mentions.count() == 2


def test_sinks(spark, folder, tmp_path):
    docs = source.readable(source.extracted(spark, folder))
    source.write_documents(docs.select("document_id", "document_type"), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    v = spark.createDataFrame([("a", "d1"), ("b", "d2")], "id string, document_id string")
    source.write_vectors(v, str(tmp_path / "v"))
    source.write_vectors(v.where("document_id = 'd1'").withColumn("id", F.lit("c")), str(tmp_path / "v"))
    assert {(r.id, r.document_id) for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {("c", "d1"), ("b", "d2")}


def test_quotes_source(spark):
    quotes.register(spark)
    rows = spark.read.format("quotes").option("tickers", "aaa, bbb,ccc").option("batch", "2").load().collect()
    assert sorted(r.ticker for r in rows) == ["AAA", "BBB", "CCC"]


# Chunking against a plain version


def plain_chunks(sentences, most, overlap):
    """Word for word what packing is to do, on whole lists."""
    out, now = [], []
    size = lambda xs: sum(chunking.tokens_of(x[0]) for x in xs)
    total = 0
    for s in sentences:
        if now and now[-1][2] != s[2]:
            out.append(now)
            now, total = [], 0
        if now and total + chunking.tokens_of(s[0]) > most:
            out.append(now)
            tail = []
            for x in reversed(now):
                if size([x, *tail]) > overlap:
                    break
                tail = [x, *tail]
            now, total = list(tail), size(tail)
        now = now + [s]
        total += chunking.tokens_of(s[0])
    join = lambda xs: " ".join(x[0] for x in xs)
    return out + ([now] if now and (not out or join(now) != join(out[-1])) else [])


def test_packing_equals_plain():
    rng = random.Random(6)
    for _ in range(150):
        sentences = [("w " * rng.choice([1, 3, 8, 30]) + ".", i // 5, rng.choice(["a", "a", "a", None])) for i in range(rng.randrange(40))]
        most, overlap = rng.choice([(20, 5), (64, 12), (10, 0)])
        assert chunking.packed(sentences, most, overlap) == plain_chunks(sentences, most, overlap)


def test_sentences():
    assert chunking.sentences_of(" One. Two? Three!  Four ") == ["One.", "Two?", "Three!", "Four"]
    long = "; ".join(["word " * 100] * 3) + "."
    parts = chunking.sentences_of(long)
    assert all(chunking.tokens_of(p) <= 200 for p in parts) and " ".join(parts).split() == long.split()
    hard = chunking.sentences_of("w " * 1000)
    assert all(chunking.tokens_of(p) <= 200 for p in hard) and " ".join(hard).split() == ["w"] * 1000
    assert chunking.sentences_of(None) == chunking.sentences_of(" ") == []
    with pytest.raises(ValueError):
        chunking.check_sizes(100, 200, 5)


def test_expressions_give_what_plain_python_gives(spark):
    rng = random.Random(11)
    bits = ["Net revenue rose", "in 2024; ", "it fell: ", "so - ", "yes, and ", "no, or ", "why? ", "One. ", "Two!", "\n", "\n\n", "  ", "word " * 60, "a.b ", "…"]
    texts = [None, "", " \n", "w " * 1_000, "; ".join(["word " * 100] * 3) + "."] + ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for large in (100_000, 60):
        got = {r.i: r.s for r in df.select("i", chunking.sentences(F.col("t"), large).alias("s")).collect()}
        assert [got[i] for i in range(len(texts))] == [chunking.sentences_of(t, large) for t in texts]
    packs = []
    for i in range(120):
        said = [(f"s{rng.randrange(4)} " * rng.choice([1, 3, 8, 30]), 0, rng.choice("aab")) for _ in range(rng.randrange(40))]
        packs.append((i, [chunking.tokens_of(x) for x, *_ in said], [k > 0 and said[k][2] != said[k - 1][2] for k in range(len(said))], said))
    df = spark.createDataFrame([p[:3] for p in packs], "i int, t array<int>, f array<boolean>")
    for most, overlap in ((20, 5), (64, 12), (10, 0)):
        got = {r.i: [tuple(b) for b in r.b] for r in df.select("i", chunking.chunk_bounds(F.col("t"), F.col("f"), most, overlap).alias("b")).collect()}
        for i, *_, said in packs:
            chunks = [said[b:e] for b, e in got[i]]
            if len(chunks) > 1 and [x[0] for x in chunks[-1]] == [x[0] for x in chunks[-2]]:
                chunks.pop()
            assert chunks == plain_chunks(said, most, overlap)


def test_own_splitters(spark):
    pages = spark.createDataFrame([("d", 1, None, "a b|c d|e f")], "document_id string, page_number int, section string, text string")
    bars = lambda t: (t or "").split("|")
    parents = chunking.chunk_documents(pages, 4, 1, bars)
    assert [r.text for r in parents.orderBy("parent_index").collect()] == ["a b c d", "e f"]
    assert chunking.chunk_text("a b|c d|e f", 4, 1, bars) == ["a b c d", "e f"]


def test_sections_and_pages(spark):
    pages = spark.createDataFrame([("d", 1, None, "A b."), ("d", 2, "X", "C d."), ("d", 3, "", "E f."), ("d", 4, "Y", "G h."), ("e", 1, None, None)], "document_id string, page_number int, section string, text string")
    got = [(r.text, r.start_page, r.end_page, r.section) for r in chunking.chunk_documents(pages).orderBy("parent_index").collect()]
    assert got == [("A b.", 1, 1, None), ("C d. E f.", 2, 3, "X"), ("G h.", 4, 4, "Y")]
    children = chunking.children_of(chunking.chunk_documents(pages, 8, 2), 4, 1).orderBy("child_index_in_document").collect()
    assert all(r.start_page <= r.end_page for r in children)


# Changes of tables


def test_company_upsert(spark):
    old = spark.createDataFrame([("AAA", "Alpha", "tech"), ("BBB", "Beta", None)], "ticker string, name string, sector string")
    new = spark.createDataFrame([("aaa", None, "chips"), ("ccc", None, None)], "ticker string, name string, sector string")
    assert sorted(map(tuple, load.upsert_companies(old, new).collect())) == [("AAA", "Alpha", "chips"), ("BBB", "Beta", None), ("CCC", "CCC", None)]


def test_metrics_upsert_takes_nulls_too(spark):
    old = spark.createDataFrame([(1, 2024, 5.0), (1, 2023, 4.0)], "company_id int, fiscal_year int, revenue double")
    new = spark.createDataFrame([(1, 2024, 9.0, 1), (1, 2024, None, 2), (2, 2024, 1.0, 3)], "company_id int, fiscal_year int, revenue double, seq int")
    assert sorted(map(tuple, load.upsert(old, new, ["company_id", "fiscal_year"], "seq").collect())) == [(1, 2023, 4.0), (1, 2024, None), (2, 2024, 1.0)]
    assert sorted(map(tuple, load.replaced(old, old.limit(0), "company_id").collect())) == sorted(map(tuple, old.collect()))


def test_manifest_decisions(spark):
    manifest = spark.createDataFrame([("a", "h1"), ("b", "h2")], "doc_id string, file_hash string")
    files = spark.createDataFrame([("a", "h1"), ("b", "other"), ("c", None)], "doc_id string, file_hash string")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(load.to_process(manifest, files)) == ["c"]
    assert ids(load.to_process(manifest, files, if_changed=True)) == ["b", "c"]
    assert ids(load.to_process(manifest, files, force=True)) == ["a", "b", "c"]


def test_warnings_count_zero_as_missing(spark):
    row = spark.range(1).select(load.load_warnings(F.array(F.struct(F.lit(2024).alias("fiscal_year"), F.lit(0.0).alias("revenue"), F.lit(2.0).alias("net_income"))), F.lit(0), F.lit(3), F.lit(None).cast("int"), F.lit(True)).alias("w")).first()
    assert row.w == ["Missing revenue for year 2024", "No segment revenue", "No risk factors"]


def test_chunk_queries_take_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: chunking.chunk_text(t, 1024, 50) for i, t in texts.items()}
    got: dict = {}
    for r in queries.QUERIES["chunk_semantic"](spark, sf).orderBy("parent_index").collect():
        got.setdefault(r.document_id, []).append(r.text)
    assert got == {i: c for i, c in want.items() if c} and max(map(len, got.values())) > 3
    children = {(i, c, k) for i, cs in want.items() for c, t in enumerate(cs) for k in range(len(chunking.chunk_text(t, 256, 50)))}
    rows = queries.QUERIES["chunk_parent_child"](spark, sf).collect()
    assert len(rows) == len(children) and {r.child_id for r in rows} == {f"{i}_parent_{c}_child_{k}" for i, c, k in children}
    assert sum(r.children for r in queries.QUERIES["chunk_stats"](spark, sf).collect()) == len(children)


def test_manifest_is_updated_by_document(spark):
    old = spark.createDataFrame([("a", 1, 5, True), ("b", 2, 5, True)], "doc_id string, page_count int, extracted_at int, indexed boolean")
    done = spark.createDataFrame([("b", 9, 6), ("b", 8, 7), ("c", 3, 1)], "doc_id string, page_count int, extracted_at int")
    got = sorted(map(tuple, load.updated_manifest(old, done).collect()))
    assert got == [("a", 1, 5, True), ("b", 8, 7, None), ("c", 3, 1, None)]
    assert sorted(r.doc_id for r in load.updated_manifest(old.limit(0), done).collect()) == ["b", "c"]


def test_years_and_documents(spark):
    rows = spark.createDataFrame([("a", "2024"), ("a", "999"), ("a", "x"), ("b", None)], "k string, fiscal_year string")
    assert {r.k: (r.years, r.latest) for r in load.years_of(rows, ["k"]).collect()} == {"a": ([2024, 999], 2024), "b": ([], None)}
    known = spark.createDataFrame([("a", "t", "x", 1, None), ("b", "u", "y", 2, 3)], "document_id string, title string, note string, created_at int, updated_at int")
    found = spark.createDataFrame([("b", None, "10k"), ("c", "new", "ref")], "document_id string, title string, kind string")
    got = {r.document_id: r.asDict() for r in graph.merged_documents(known, found, F.lit(9)).collect()}
    assert (got["a"]["created_at"], got["a"]["updated_at"], got["a"]["kind"]) == (1, None, None)
    assert (got["b"]["created_at"], got["b"]["updated_at"], got["b"]["title"], got["b"]["note"], got["b"]["kind"]) == (2, 9, "u", "y", "10k")
    assert (got["c"]["created_at"], got["c"]["updated_at"], got["c"]["title"], got["c"]["note"]) == (9, None, "new", None)
