from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from ledgerlens.operators import pruned, vector
from ledgerlens.operators.pruned import dense_search, pruned_top_k, sparse_search, store_cells, store_postings


def docs(spark, n=600):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randrange(0, 60)))) for i in range(n)]
    rows[17] = (17, "rare " * 30 + "w1 w2")
    rows[18] = (18, None)
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(3)


def terms(spark, words):
    from pyspark.sql import functions as F

    from ledgerlens.functions.text import bucket

    return spark.createDataFrame(list(words.items()), "token string, w double").select(bucket(F.col("token")).alias("idx"), "w")


def plain(rows, words, k):
    scores = {i: sum(math.log1p(n) * words[t] for t, n in Counter((text or "").split()).items() if t in words) for i, text in rows}
    hit = {i: s for i, s in scores.items() if any(t in words for t in (dict(rows)[i] or "").split())}
    return [(i, round(s, 9)) for i, s in sorted(hit.items(), key=lambda p: (-round(p[1], 9), p[0]))][:k]


def test_sparse_search_is_exact_and_reads_less(spark, tmp_path):
    rows, df = docs(spark)
    store_postings(df, "id", "text", str(tmp_path), part_docs=8)
    for words, k in (({"rare": 2.0, "w1": 0.1, "w2": 0.1}, 1), ({"w0": 1.0, "w3": 0.5}, 10), ({"w150": 1.0}, 100), ({"none": 1.0}, 5), ({}, 3)):
        got, read = sparse_search(spark, str(tmp_path), terms(spark, words) if words else terms(spark, {"x": 1.0}).limit(0), k)
        assert sorted((r.id, round(r.score, 9)) for r in got.collect()) == sorted(plain(rows, words, k))
        assert read.parts_read <= read.parts and read.rows_read <= read.rows
        if k == 1:
            assert read.parts_read < read.parts / 2 and got.first().id == 17


def test_dense_search_is_exact_and_reads_less(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16)) * 4
    rows = [(i, (middles[i % 30] + rng.normal(size=16) * 0.2).tolist()) for i in range(900)] + [(900, [0.0] * 16), (901, None)]
    store_cells(spark.createDataFrame(rows, "vec long, values array<float>").repartition(3), "vec", "values", str(tmp_path), cells=64)
    some = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None]
    for query, k in ((middles[3], 5), (-middles[7], 12), (rng.normal(size=16), 40), (np.zeros(16), 3)):
        got, read = dense_search(spark, str(tmp_path), query.tolist(), k)
        want = sorted(((float(v @ query), i) for i, v in some), key=lambda p: (-p[0], p[1]))[:k]
        assert sorted(r.id for r in got.collect()) == sorted(i for _, i in want)
        assert read.rows == 901 and (not query.any() or read.rows_read < 700)


def test_parts_without_enough_rows(spark):
    bounds = spark.createDataFrame([(p, 1.0 - p / 100, 1) for p in range(40)], "part long, bound double, rows long")
    scores = spark.createDataFrame([(p, p, 0.5) for p in range(0, 40, 9)], "part long, id long, score double")
    for k in (3, 5, 9):
        got, read = pruned_top_k(bounds, lambda parts: scores.join(parts, "part").select("id", "score"), k, first=2)
        assert [r.id for r in got.orderBy("rank").collect()] == list(range(0, 40, 9))[:k] and read.parts_read <= 40
    assert pruned_top_k(bounds.limit(0), lambda parts: scores.join(parts, "part").select("id", "score"), 3)[0].count() == 0


def test_empty_indexes(spark, tmp_path):
    store_postings(spark.createDataFrame([], "id long, text string"), "id", "text", str(tmp_path / "a"))
    assert sparse_search(spark, str(tmp_path / "a"), terms(spark, {"a": 1.0}), 3)[0].count() == 0
    store_cells(spark.createDataFrame([], "id long, values array<float>"), "id", "values", str(tmp_path / "b"))
    assert dense_search(spark, str(tmp_path / "b"), [1.0, 2.0], 3)[0].count() == 0


def test_hybrid_equals_all_sums(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], rng.randrange(3)) for i in range(200)]
    hits = {i: rng.choice([0.5, 1.0, 3.0]) for i in rng.sample(range(200), 40)}
    vectors = spark.createDataFrame(rows, "id long, values array<double>, label int")
    index = spark.createDataFrame([(i, 5, w) for i, w in hits.items()], "id long, idx long, w double")
    asked = spark.createDataFrame([(5, 2.0)], "idx long, w double")
    for k, filters in ((1, None), (10, None), (30, {"label": 1}), (500, None)):
        got = vector.hybrid_top_k(vectors, index, [1.0, 0.5, -1.0, 0.25], asked, k, filters).orderBy("rank").collect()
        score = lambda r: sum(a * b for a, b in zip(r[1], [1.0, 0.5, -1.0, 0.25], strict=True)) + 2 * hits.get(r[0], 0)
        want = sorted(((-score(r), r[0]) for r in rows if not filters or r[2] == 1))[:k]
        assert [(r.id, round(r.score, 9)) for r in got] == [(i, round(-s, 9)) for s, i in want]
