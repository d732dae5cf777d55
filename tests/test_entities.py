from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.operators import entities
from ledgerlens.operators.entities import Automaton, apart, found_entities, indexing_statistics, needs_entities

PATTERNS = "label string, pattern string, kind string"
PAGES = "document_id string, page int, text string"


def plain(words, patterns):
    out = []
    for k in range(len(words)):
        for label, own, exact in patterns:
            said = words[k : k + len(own)]
            if own and (said == own if exact else [w.lower() for w in said] == [w.lower() for w in own]):
                out.append((k, len(own), label))
    return sorted(out)


def test_automaton_finds_what_a_plain_search_finds():
    rng = random.Random(3)
    for _ in range(300):
        letters = ["a", "b", "A", "c"]
        patterns = [(f"L{i}", rng.choices(letters, k=rng.randrange(1, 5)), rng.random() < 0.5) for i in range(rng.randrange(0, 9))]
        words = rng.choices([*letters, "d"], k=rng.randrange(0, 30))
        assert sorted(Automaton(patterns).finds(words)) == plain(words, patterns)


def test_longer_then_earlier_finds_stay():
    assert apart([(0, 2, "x"), (1, 3, "y"), (3, 2, "z"), (4, 1, "w"), (5, 1, "v")], 6) == [(1, 3, "y"), (4, 1, "w"), (5, 1, "v")]
    assert apart([(0, 2, "x"), (1, 2, "y"), (2, 2, "z")], 4) == [(0, 2, "x"), (2, 2, "z")] and apart([], 0) == []


def rows(df):
    return sorted((r.position, r.raw_text, r.type) for r in df.collect())


class Years:
    """Finds years, and all that is in brackets; one label has no type."""

    def spans(self, texts):
        return [[(m.start(), m.end(), "DATE" if m[0][0] != "(" else "UNKNOWN") for m in re.finditer(r"\b20\d\d\b|\(.*?\)", t)] + [(4, 12, "PERSON")] * (t[:1] == "T") for t in texts]


def test_pages(spark, monkeypatch):
    text = "The SEC and the Federal Reserve met in 2024; sec rules (x). Federal Reserve Bank"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, None), ("e", 1, ""), ("e", 2, "sec\nSec acme inc")], PAGES)
    patterns = spark.createDataFrame(
        [("REGULATION", "sec", "token"), ("REGULATION", "Federal Reserve", "phrase"), ("ORG", "Federal Reserve Bank", "phrase"), ("CONCEPT", "federal", "token"), ("NOTHING", "rules", "token"), ("ORG", "acme inc", "token"), ("ORG", "a", "token"), ("ORG", None, "token")], PATTERNS
    )
    want = [(0, "sec", "Regulation"), (1, "SEC", "Regulation"), (1, "Sec", "Regulation"), (2, "acme inc", "Organization"), (4, "Federal Reserve", "Regulation"), (9, "sec", "Regulation"), (12, "Federal Reserve Bank", "Organization")]
    for chars in (8 << 20, 20):  # in one automaton, and in several
        monkeypatch.setattr(entities, "AUTOMATON_CHARS", chars)
        found = found_entities(pages, patterns)
        assert rows(found) == want
        assert all(text[r.begin : r.end] == r.raw_text for r in found.where("document_id = 'd'").collect())
        more = found_entities(pages, patterns, Years())
        # The recogniser's person overlaps a pattern's find.
        assert rows(more) == sorted([*want, (8, "2024", "Date")])
    assert {r.text for r in found.collect()} >= {"acme inc", "SEC"}
    assert found_entities(pages, patterns.limit(0)).count() == 0 == found_entities(pages.limit(0), patterns).count()


def test_many_patterns(spark):
    pages = spark.createDataFrame([(f"d{i}", 1, " ".join(f"w{(i * 7 + k) % 400}" for k in range(300))) for i in range(20)], PAGES)
    patterns = spark.createDataFrame([("ORG", f"w{i} w{i + 1}" if i % 2 else f"W{i}", "token") for i in range(0, 400)], PATTERNS)
    each = [([w for w in r.text.split()], r.document_id) for r in pages.collect()]
    known = [(p.label, p.pattern.split(), False) for p in patterns.collect()]
    want = sum(len(apart(plain(words, known), len(words))) for words, _ in each)
    assert found_entities(pages, patterns).count() == want


def test_statistics(spark):
    documents = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "document_id string, text string")
    known = documents.where("document_id = 'b'")
    wanted = needs_entities(documents, known)
    assert sorted(r.document_id for r in wanted.collect()) == ["a", "c"] and needs_entities(documents, known, True).count() == 3
    pages = wanted.withColumn("page", F.lit(1))
    found = spark.createDataFrame([("a", "Acme"), ("a", "ACME"), ("c", "Beta")], "document_id string, text string")
    got = indexing_statistics(documents, wanted, pages, found, found.limit(2)).first().asDict()
    assert got == {"documents_processed": 2, "documents_skipped": 1, "total_pages": 2, "total_entity_mentions": 3, "unique_entities": 2, "relationships_created": 2}
    assert indexing_statistics(documents, wanted.limit(0), pages.limit(0), found.limit(0), found.limit(0)).first().total_entity_mentions == 0


class Recorded:
    """Counts how often it is asked."""

    def __init__(self, counter):
        self.counter = counter

    def spans(self, texts):
        self.counter.add(len(texts))
        return [[] for _ in texts]


def test_statistics_read_finds_once(spark):
    pages = spark.createDataFrame([("a", 1, "Acme met ACME, acme; Beta"), ("b", 1, "beta"), ("c", 1, None)], PAGES)
    patterns = spark.createDataFrame([("ORG", "acme", "token"), ("ORG", "beta", "token")], PATTERNS)
    asked = spark.sparkContext.accumulator(0)
    found = found_entities(pages, patterns, Recorded(asked))
    got = indexing_statistics(pages, pages, pages, found).first()
    assert got.asDict() == {"documents_processed": 3, "documents_skipped": 0, "total_pages": 3, "total_entity_mentions": 5, "unique_entities": 2, "relationships_created": 3}
    assert asked.value == 3
    assert indexing_statistics(pages, pages, pages, found.limit(0)).first().relationships_created == 0


def test_finds_do_not_carry_their_page(spark):
    text = "é acme \U0001f600 " * 3000
    pages = spark.createDataFrame([("a", 1, text), ("b", 2, "x Acme")], PAGES)
    found = found_entities(pages, spark.createDataFrame([("ORG", "acme", "token")], PATTERNS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate explode" in x)
    assert "text" not in generate.split("Generate")[1].split("hits")[0]
    scan = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert ", text#" not in scan.split(")")[1]
    got = found.where("document_id = 'a'").agg(F.count("*").alias("n"), F.collect_set("raw_text").alias("raw"), F.max("end").alias("last")).first()
    assert (got.n, got.raw, got.last) == (3000, ["acme"], len(text) - 3)


def test_words_of_many_texts_are_those_of_each():
    rng = random.Random(5)
    texts = [None, "", "-", "a", "b.", "-/.", "é", "x&", "&y"] + ["".join(rng.choices("aB3&./- é\n\U0001f600", k=rng.randrange(0, 12))) for _ in range(2000)]
    for given in (pa.array(texts), pa.array(["zz", *texts, "yy"]).slice(1, len(texts)), pa.array(texts[:1], pa.string()), pa.array([], pa.string())):
        w = entities.words_of(given)
        want = [[m.group() for m in entities.WORD.finditer(t or "")] for t in given.to_pylist()]
        said, lower = w.said.to_pylist(), w.lower.to_pylist()
        assert [said[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == want
        assert [x for part in want for x in part] == [bytes(w.data[a:b]).decode() for a, b in zip(w.begin, w.end, strict=True)] and lower == [x.lower() for x in said]


def test_finds_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(6)
    letters = ["a", "b", "A", "c"]
    for _ in range(60):
        patterns = list({(tuple(rng.choices(letters, k=rng.randrange(1, 5))), rng.random() < 0.5): None for _ in range(rng.randrange(1, 9))})
        known = sorted(((f"{rng.choice(['ORG', 'LAW', 'NONE'])}", [w if exact else w.lower() for w in own], exact) for own, exact in patterns), key=lambda p: not p[2])
        texts = [rng.choice(["é ", ""]) + rng.choice([" ", "  ", ", "]).join(rng.choices([*letters, "d"], k=rng.randrange(0, 30))) for _ in range(12)]
        want = []
        for t in texts:
            places = [m.span() for m in entities.WORD.finditer(t)]
            # Of equals the exact ones come first.
            finds = [(k, n, label) for exact in (True, False) for k, n, label in plain([t[b:e] for b, e in places], [p for p in known if p[2] == exact])]
            left = {(k, n): (k, n) for k, n, _ in apart(finds, len(places))}
            want.append([(k, n, places[k][0], places[k + n - 1][1]) for k, n in left])
        labels = Automaton(known)
        monkeypatch.setattr(entities, "SHORTEST", 0)
        monkeypatch.setattr(entities, "LABELS", {"ORG": "o", "LAW": "l", "NONE": "n"})
        got = entities._hits(labels, pa.array(texts), True).to_pylist()
        assert [[(h["position"], h["size"], h["begin"], h["end"]) for h in page] for page in got] == want
        assert all(h["raw_text"] == t[h["begin"] : h["end"]] for page, t in zip(got, texts, strict=True) for h in page)


def test_texts_are_read_many_at_a_time(monkeypatch):
    monkeypatch.setattr(entities, "PART_BYTES", 8)
    sizes = [p.num_rows for p in entities._parts(pa.RecordBatch.from_arrays([pa.array([1] * 5)] * 2 + [pa.array(["abc", None, "x" * 40, "", "yy"])], names=["a", "b", "text"]))]
    assert sizes == [2, 1, 2]


def test_finds_of_a_page_are_one_row(spark):
    pages = spark.createDataFrame([("a", 1, "Acme met ACME\n beta"), ("a", 2, "none"), ("b", 1, None)], PAGES)
    patterns = spark.createDataFrame([("ORG", "acme", "token"), ("LAW", "ACME beta", "phrase"), ("NOTHING", "met", "token")], PATTERNS)
    got = {(r.document_id, r.page): [(h.position, h.size, h.type, h.begin, h.end, h.raw_text) for h in r.hits] for r in entities.found_by_page(pages, patterns).collect()}
    assert got == {("a", 1): [(0, 1, "Organization", 0, 4, "Acme"), (2, 2, "Regulation", 9, 19, "ACME\n beta")], ("a", 2): [], ("b", 1): []}


def test_entity_extraction_makes_no_row_of_a_find(spark, tmp_path):
    # Its finds are gathered by document anyway, so they stay lists of their pages.
    from ledgerlens.queries.graphs import entity_extraction

    words = " ".join(f"w{k}" for k in range(13))
    spark.createDataFrame([(words,)], "text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, words), (1, "W0"), (2, "x"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entity_extraction(spark, str(tmp_path))
    assert "Generate explode(hits" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.mentions) for r in got.collect()] == [(1, 6)]  # three and two of three and two words, and one word alone
