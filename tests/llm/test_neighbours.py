from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import neighbours


def exact(ids, x, query, k):
    d = np.sqrt(((x - x[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_recall_and_distances(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1500)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32))
    if kind == "clusters":
        x = x * 0.1 + rng.standard_normal((20, 32))[rng.integers(0, 20, 4000)]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    rows = neighbours.nearest(df, df.where("vec_id % 100 = 0"), 10, "vec_id", "embedding").collect()
    assert len(rows) == 400
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, wide, hits = np.arange(4000), x.astype(float), 0
    for q, found in got.items():
        want = exact(ids, wide, q, 10)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        assert all(abs(s - np.sqrt(((wide[i] - wide[q]) ** 2).sum())) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
    assert hits / 400 >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (100, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id % 100 = 0"), 10, "vec_id", "embedding").orderBy("query_id", "rank").collect()]
    root = 2**0.5
    assert got == [(0, 1, 7, 0.0), (0, 2, 100, root), (100, 1, 0, root), (100, 2, 7, root)]
    assert neighbours.nearest(df.limit(0), df.limit(0), 10, "vec_id", "embedding").count() == 0


def test_ties_go_to_smaller_ids():
    x = np.ones((300, 8))
    index = neighbours.CollisionIndex(np.arange(300)[::-1].copy(), x)
    ids, distances, _ = index.search(5, x[0], 10)
    assert ids.tolist() == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10] and not distances.any()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query_and_share_verified(spark, sf):
    """The query on ``embeddings`` against brute force, and how many vectors it verifies."""
    from ledgerlens.llm.queries import QUERIES

    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted((r.vec_id, r.embedding) for r in table if r.embedding and all(a is not None and np.isfinite(a) for a in r.embedding) and any(r.embedding))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = {}
    for r in QUERIES["op5_neighbours"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [k for k, i in enumerate(ids.tolist()) if i % 100 == 0]
    hits = sum(len({i for i, _ in exact(ids, x, k, 10)} & got[int(ids[k])]) for k in asked)
    assert set(got) == {int(ids[k]) for k in asked} and hits >= 0.93 * 10 * len(asked)
    index = neighbours.CollisionIndex(ids, x)
    share = np.mean([index.search(int(ids[k]), x[k], 10)[2] for k in asked]) / len(ids)
    print(sf, "recall", hits / 10 / len(asked), "verified", share)
    assert share < (0.2 if sf == "sf0.1" else 0.5)


def test_clashing_columns_and_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 9, 9, "x") for i in range(150)], "vec_id long, embedding array<float>, block int, kind int, id string")
    got = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 100"), 3, "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0)]


def test_lines_keep_distances():
    x = np.random.default_rng(3).standard_normal((40, 24))
    turned = x @ neighbours.lines(24, 48) / np.sqrt(48)
    assert np.allclose(((x[:, None] - x) ** 2).sum(2), ((turned[:, None] - turned) ** 2).sum(2))
