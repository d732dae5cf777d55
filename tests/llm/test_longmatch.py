from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm.longmatch import LENGTH, RunIndex, passage_digests, repeated_windows, without_passages


def plain(texts):
    """Per text: bytes, removed, spans, hash of the rest."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r) + 2)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i + 1 : i + 1 + LENGTH] = b"\1" * LENGTH
        marks = gone[1:-1]
        spans = sum(gone[i] and not gone[i - 1] for i in range(1, len(gone)))
        out.append((len(r), sum(marks), spans, hashlib.sha256(bytes(b for b, m in zip(r, marks, strict=True) if not m)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def noise(n, letters="abcdefghij é"):
        return "".join(rng.choices(letters, k=n))

    shared = [noise(n) for n in (399, 400, 401, 460, 700, 1500, 90)]
    texts = [None, "", noise(50), "a" * 900, "ab" * 450, noise(1200, "ab") * 2]
    for _ in range(40):
        t = "".join(noise(rng.choice([0, 3, 120])) + rng.choice(shared) for _ in range(rng.randrange(1, 5)))
        texts.append(t + noise(30))
    copy = noise(2500)
    for _ in range(12):
        t = list(copy)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts + texts[:9]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 20_000), (2, 3), (3, 0)])
def test_equals_brute_force(spark, seed, crowd):
    texts = corpus(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r[1:] for r in passage_digests(spark.createDataFrame(rows, "doc_id long, text string, spans string"), crowd).collect()}
    assert [tuple(got[i]) for i in range(len(texts))] == plain(texts)


def test_planted_passages_go_by_their_bytes(spark):
    """Passages of over 50 words that repeat across documents: those of 400 bytes go from each of these, shorter ones stay, and the text's own size tells nothing."""
    rng = random.Random(12)

    def words(n, letters, size):
        return " ".join("".join(rng.choices(letters, k=size)) for _ in range(n))

    long, short = words(60, "abcdefgh", 6), words(60, "ijklmnop", 5)
    assert len(long) == 419 and len(short) == 359
    texts = [f"{words(30, 'qrstuvwxyz', 7)}{a}{p}{b}{words(30, 'qrstuvwxyz', 7)}" for p in (long, short, "") for a, b in ("<>", "[]")]
    got = {r.doc_id: r for r in passage_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(6)] == [419, 419, 0, 0, 0, 0]
    assert [got[i].n_spans for i in range(6)] == [1, 1, 0, 0, 0, 0]
    assert [got[i].n_bytes for i in range(6)] == [len(t) for t in texts]


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    part = "".join(rng.choices("abcdef", k=800))
    rows = [(None, part), (3, part[:500] + "zz" + part[500:]), (3, part[:500] + "zz" + part[500:]), (None, "q" + part[100:])]
    got = sorted(tuple(r[1:]) for r in passage_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(plain([t for _, t in rows]))
    assert passage_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_left(spark):
    passage = "é" * 250
    rows = [(1, "one " + passage + " end"), (2, "two " + passage + ".")]
    got = {r.doc_id: r.text for r in without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "one end", 2: "two."} or got == {1: "one  end", 2: "two ."}


def test_windows_of_one_gram():
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 100, 760).astype(np.uint8))
    texts, left, group = [], [], []
    for g in range(3):
        for _ in range(25):
            le, ri = int(rng.integers(0, 300)), int(rng.integers(-60, 1))
            t = bytearray(base[368 - le : 368 - ri + LENGTH - 0][: le - ri + LENGTH])
            for _ in range(int(rng.integers(0, 3))):
                t[int(rng.integers(len(t)))] = 97
            texts.append(bytes(t))
            left.append(le)
            group.append(g)
    flags = repeated_windows(texts, np.array(left), np.array(group))
    seen = Counter((g, 368 - le + k, t[k : k + LENGTH]) for t, le, g in zip(texts, left, group, strict=True) for k in range(len(t) - LENGTH + 1))
    for f, t, le, g in zip(flags, texts, left, group, strict=True):
        want = {368 - le + k for k in range(len(t) - LENGTH + 1) if seen[g, 368 - le + k, t[k : k + LENGTH]] > 1}
        assert set(np.flatnonzero(f).tolist()) == want


def test_index_follows_runs_and_counts_copies():
    """Rows that differ in one byte only: a column has two runs where they differ, and no more than that is kept."""
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, 700).astype(np.uint8)
    texts = []
    for i in range(40):
        t = base.copy()
        t[600] = 48 + i % 10
        texts.append(t.tobytes())
    group, begin = np.zeros(40, int), np.full(40, 20)
    index = RunIndex.of(texts, begin, group)
    assert sorted(set(index.column.tolist())) == [620, 621] or set(index.column.tolist()) == {620}
    assert len(index.column) <= 40 + 10 and index.length.sum() % 40 == 0
    assert sorted(set(index.symbol.tolist())) == list(range(48, 58))
    one = repeated_windows([texts[0]], np.array([300]), np.array([0]))
    assert not one.any()
    assert repeated_windows([texts[0]], np.array([300]), np.array([0]), np.array([2]))[0, 68 : 68 + 301].all()


def test_very_long_texts(spark):
    """Texts of 20 MB, cut into pieces at other places: all that they share goes, and nothing else."""
    shared = np.random.default_rng(6).integers(97, 123, 20_000_000).astype(np.uint8).tobytes().decode()
    own = np.random.default_rng(7).integers(97, 123, 3_000_000).astype(np.uint8).tobytes().decode()
    rows = [(1, shared), (2, "head " + shared[1_000:] + " tail"), (3, own), (4, own[:300])]
    got = {r.doc_id: tuple(r[1:4]) for r in passage_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == (20_000_000, 19_999_000, 1) and got[2] == (19_999_010, 19_999_000, 1)
    assert got[3] == (3_000_000, 0, 0) and got[4] == (300, 0, 0)
