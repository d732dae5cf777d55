from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.operators import vector
from ledgerlens.providers import Cache, HashedTerms, RuleAnalyst, distinct_variants, retried
from ledgerlens.schema import ENTITY_TYPES, entity_type, is_entity_type, is_relation_type


def texts():
    rng = random.Random(2)
    bits = ["Revenue", "the", "per", "Q3", "net", "a", "I", "2024", "10-K", "été", "year", "x", "NVIDIA", "not", "\n", "  ", ".", "don't", "\t"]
    return ["", " ", "NVIDIA nvidia the", *(" ".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(80))]


def plain_tokens(t):
    return [w for w in re.findall("[a-zA-Z0-9]+", t.lower()) if len(w) >= 2 and w not in T.STOPWORDS]


def plain_bucket(w):
    return int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % (2**31 - 1)


def test_encoder_equals_plain(spark):
    given = texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", T.tokens(F.col("t")).alias("w"), vector.term_weights(F.col("t")).alias("v"), T.token_count(F.col("t")).alias("n")).orderBy("i").collect()
    for r, t in zip(rows, given, strict=True):
        words = plain_tokens(t)
        assert r.w == words
        counts = Counter(map(plain_bucket, words))
        assert [(x.idx, round(x.w, 12)) for x in r.v] == [(b, round(log(1 + n), 12)) for b, n in counts.items()]
        assert r.n == (0 if not t else max(1, int(len(t.split()) * 1.3)))
    assert plain_bucket("nvidia") == 1410201592
    assert {"per", "year", "net", "total"}.isdisjoint(T.STOPWORDS)


def test_index_rows_equal_vectors(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, t string")
    one = {(r.id, r.idx): round(r.w, 12) for r in vector.sparse_index(df, "i", "t").collect()}
    two = {(r.i, x.idx): round(x.w, 12) for r in df.select("i", vector.term_weights(F.col("t")).alias("v")).collect() for x in r.v}
    assert one == two


def test_hashed_terms_are_the_same_on_driver_and_executors(spark):
    e = HashedTerms(16)
    given = texts()[:20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", e.column(F.col("t")).alias("v")).orderBy("i").collect()
    for r, t in zip(rows, given, strict=True):
        assert all(abs(a - b) < 1e-6 for a, b in zip(r.v, e.embed(t), strict=True))


def test_nulls(spark):
    df = spark.createDataFrame([(None, None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    row = df.select(T.token_count(a).alias("n"), T.filled(a, b).alias("f"), T.not_relevant(a).alias("r"), T.citation(a, a, a, a, a, a, a, a).alias("c"), T.safe_decimal(a).alias("d"), T.is_10k(a, b).alias("k"), T.friendly_error(F.lit("")).alias("e")).first()
    assert (row.n, row.f, row.r, row.d, row.k) == (0, None, True, None, False)
    assert row.c == "Unknown, Unknown Section, Page ?" and row.e.startswith("Something")


def test_labels(spark):
    row = spark.range(1).select(entity_type(F.lit("org")).alias("a"), entity_type(F.lit("GPE")).alias("b"), entity_type(F.lit("??")).alias("c")).first()
    assert tuple(row) == ("Organization", "Location", None)
    assert is_entity_type("PERSON") and not is_entity_type("thing") and is_relation_type("mentions") and len(ENTITY_TYPES) == 10


def test_providers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    waits = []
    assert retried(flaky, sleep=waits.append) == "up" and waits == [0.1, 0.2]
    young, old = Cache(2), Cache(2, touch=False)
    for c in (young, old):
        for k in ("a", "b", "a", "c"):
            c.get(k, k.upper)
    assert list(young.held) == ["a", "c"] and list(old.held) == ["b", "c"] and young.rate == 0.25 and Cache(1).rate == 0
    assert distinct_variants("What is X?", ["what is x? ", "short", "another one", "Another One", "third way", "fourth way"]) == ["What is X?", "another one", "third way", "fourth way"]
    a = RuleAnalyst()
    assert a.analyse("how do A and B compete").complex and a.analyse("x" * 900).variants[0] == "x" * 500

#: Functions on given values, and what they are to give.
CASES: dict[str, tuple[list[tuple], dict]] = {}


def _case(name, rows, given, results):
    CASES[name] = rows, results


_case("doc_id_clean", [("NVDA_10K_2025.pdf", "NVDA_10K_2025", "10k"), ("a b&c.news.pdf", "a_b_c_news", "reference"), ("x_10k_y.PDF", "x_10k_y", "10k"), ("no stem", "no_stem", "reference")], "name", {"document_id": ("string", T.document_id), "kind": ("string", T.document_type)})
_case(
    "ticker_extract",
    [("AAPL_10K_2024", "AAPL", "AAPL", "AAPL", "AAPL"), ("AAPL_10k_x", None, "AAPL", "AAPL", "AAPL"), ("TOOLONG_10K_2024", None, None, "TOOLONG", None), ("A_news", None, "A", None, None), ("aapl_10K_2024", None, None, "aapl", None), ("B_10K_2020", "B", "B", "B", None), ("MSFT", None, None, None, "MSFT")],
    "doc",
    {"of_filing": ("string", T.ticker_of_filing), "of_name": ("string", T.ticker_of_name), "of_parts": ("string", T.ticker_of_parts), "of_upper": ("string", T.ticker_of_upper)},
)
_case("safe_decimal_int", [("$1,234.50", 1234.5, None), ("n/a", None, None), ("-", None, None), (" 12 ", 12.0, 12.0), ("2025.0", 2025.0, 2025.0), ("abc", None, None), ("", None, None), ("None", None, None), ("-3.7", -3.7, -3.0)], "value", {"dec": ("double", T.safe_decimal), "whole": ("double", T.safe_int)})
_case("score_parse", [("8", 8.0), ("Score: 7.5/10", 7.5), ("99", 10.0), ("0", 1.0), ("none", 5.0), ("", 5.0)], "answer", {"score": ("double", T.parsed_score)})
_case(
    "not_relevant_flag",
    [("NOT_RELEVANT", True), ("  ", True), ("", True), ("Sorry, no relevant sentences.", True), ("There is nothing relevant in this one, but it goes on for more than fifty characters.", False), ("Revenue rose.", False), ("not_relevant at all in this long passage that goes on and on and on", True)],
    "answer",
    {"skip": ("boolean", T.not_relevant)},
)
_case("thinking_split", [("<thinking>a b</thinking> done", "a b", "done"), ("plain ", None, "plain "), ("x<Thinking>1</THINKING>y<thinking>2</thinking>", "1", "xy")], "content", {"thought": ("string", lambda c: T.thinking(c)[0]), "said": ("string", lambda c: T.thinking(c)[1])})
_case("companies", [("x\nNVIDIA CORPORATION\nmore", "Nvidia Corporation"), ("x\n at&t inc.  \ny", None), ("x\nAT&T INC.\n", "At&T Inc."), ("x\nBlue Sea Llc\n", "Blue Sea LLC"), ("ACME CORP\n", None), ("a" * 3000 + "\nACME CORP\n", None), (None, None)], "text", {"company": ("string", T.company_of)})
_case("error_kinds", [("HTTP 429", "rate limit"), ("Read timed out", "timeout"), ("Tool crashed", "tool"), ("Model unavailable", "model"), ("?", "other")], "message", {"kind": ("string", T.error_kind)})
_case("ticker_lists", [("aapl, msft,,", "AAPL|MSFT"), (" nvda ", "NVDA"), (",", "")], "given", {"symbols": ("string", lambda c: F.array_join(T.ticker_list(c), "|"))})
_case("epoch_times", [("0", "1970-01-01T00:00:00+00:00"), ("1700000000", "2023-11-14T22:13:20+00:00")], "seconds", {"iso": ("string", lambda c: T.epoch_text(c.cast("bigint")))})
_case("epoch_times_of_long_years", [("253402300799", "9999-12-31T23:59:59+00:00"), ("253402300800", "10000-01-01T00:00:00+00:00"), ("518394000001", "18397-04-02T13:20:01+00:00")], "seconds", {"iso": ("string", lambda c: T.epoch_text(c.cast("bigint")))})
_case("companies_by_words", [("x\nAT&T INC.\n", "At&t Inc."), ("x\nTHE EN COMPANY \n OF POCO\n", "The En Company \n Of Poco"), ("x\nACME\nAND COMPANY\n", "Acme\nand Company"), ("x\nBlue  Sea Llc\n", "Blue  Sea LLC"), ("x", None)], "text", {"company": ("string", lambda c: T.company_of(c, T.titled_words))})
_case("fence_strip", [("```json\n{}\n```", "{}"), ("SELECT 1", "SELECT 1"), ("```\na\n```", "a")], "answer", {"bare": ("string", T.without_fence)})
_case("ten_k_flag", [("10K", True), ("sec_10k", True), ("reference", False), ("", False)], "kind", {"filing": ("boolean", lambda c: T.is_10k(F.lit(None).cast("string"), c))})


def _entity(c):
    return T.entity_text(F.split_part(c, F.lit("|"), F.lit(2)), F.split_part(c, F.lit("|"), F.lit(1)))


_case("entity_text_normalize", [("Organization|  acme   works ", "Acme Works"), ("Organization|acme inc", "acme inc"), ("Person|Jane doe", "Jane doe"), ("Person|jane doe", "Jane Doe"), ("Concept|net   income", "net income"), ("Concept|P/E", "P/E"), ("Organization|IBM", "IBM")], "mention", {"normal": ("string", _entity)})


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    rows, results = CASES[name]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, given string")
    got = df.select("i", *(fn(F.col("given")).cast(kind).alias(c) for c, (kind, fn) in results.items())).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]
