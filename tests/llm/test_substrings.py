from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import substrings
from ledgerlens.llm.queries import op13_substrings
from ledgerlens.llm.substrings import anchors, deep_nodes, repeats, substring_digests, without_substrings, word_hashes

SF = "/root/testdata/sf0.001"
LARGEST = 1 << 63


def plain(rows):
    """By a table of all windows."""
    least, out = {}, []
    for doc, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            least[w] = min(least.get(w, LARGEST), LARGEST if doc is None else doc)
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 12):
            if least[tuple(words[k : k + 13])] < (LARGEST if doc is None else doc):
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def texts(rng):
    """Few words, so that windows, grams and prefixes meet often; passages that texts share, copies, and odd white space and bytes."""
    some = [f"w{i}" for i in range(300)] + ["é", "a\x01", "\x02", "a", "日本", "\x00"]
    passages = [[rng.choice(some) for _ in range(rng.choice([13, 14, 20, 60]))] for _ in range(6)]
    out = []
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += [rng.choice(some) for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                words += p[rng.randrange(0, 4) : len(p) - rng.randrange(0, 4)]
        out.append("".join(w + rng.choice([" ", "\n", "\t  "]) for w in words))
    return [*out, *out[:20], "same " * 500, "same " * 40, "x y " * 30, None, "", " \n", " ".join(passages[3])]


def test_anchors_of_equal_windows_are_equal():
    given = [t.encode() for t in texts(random.Random(3)) if t]
    h, sizes = word_hashes(given)
    assert sizes.tolist() == [len(t.split()) for t in given]
    words = [w for t in given for w in t.split()]
    assert len(set(words)) == len(set(h.tolist())) == len(set(zip(words, h.tolist(), strict=True)))
    owner, at, first, last, gram = anchors(h, sizes)
    found, count = {}, 0
    ends = np.cumsum(sizes)
    for o, k, f, e, g in zip(owner.tolist(), at.tolist(), first.tolist(), last.tolist(), gram.tolist(), strict=True):
        for s in range(f, e + 1):
            assert 0 <= k - s <= 8 and s + 13 <= ends[o]
            assert found.setdefault(tuple(words[s : s + 13]), (k - s, g)) == (k - s, g)
            count += 1
    assert count == sum(max(0, n - 12) for n in sizes.tolist())


def test_hashing_in_steps(monkeypatch):
    given = [b"a b  c " * 40, b"", b"word" * 3_000 + b" x", b" \n"]
    want = word_hashes(given)[0].tolist()
    monkeypatch.setattr(substrings, "STEP", 7)
    assert word_hashes(given)[0].tolist() == want


def test_deep_nodes_are_maximal():
    rng = random.Random(1)
    for _ in range(300):
        tails = sorted(b" ".join(rng.choices([b"a", b"b", b"c"], k=rng.randrange(0, 5))) for _ in range(rng.randrange(2, 12)))
        tails.sort(key=lambda t: t.split())
        words = [tuple(t.split()) for t in tails]
        paths = {w[:d] for w in words for d in range(len(w) + 1)}
        want = set()
        for path in paths:
            below = [k for k, w in enumerate(words) if w[: len(path)] == path]
            follow = {words[k][len(path) : len(path) + 1] for k in below}
            if len(below) > 1 and (len(follow) > 1 or follow == {()}):
                want.add((len(path), below[0], below[-1] + 1))
        assert set(deep_nodes(tails)) == want | {(0, 0, len(words))} and len(deep_nodes(tails)) == len(set(deep_nodes(tails)))


@pytest.mark.parametrize("small", [False, True])
def test_documents(spark, monkeypatch, small):
    if small:  # everything is hot: grams, copies and prefixes of each length
        monkeypatch.setattr(substrings, "FEW", 1)
        monkeypatch.setattr(substrings, "HOT", 20)
        monkeypatch.setattr(substrings, "SHARES", 300)
        monkeypatch.setattr(substrings, "FLUSH", 500)
    rng = random.Random(8)
    given = texts(rng)
    rng.shuffle(given)
    rows = [(rng.choice([i, i, i, 7, None]), t) for i, t in enumerate(given)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, first int, t1 string").repartition(3)
    want = plain(rows)
    assert Counter(map(tuple, substring_digests(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == Counter(w[:4] for w in want)
    if not small:
        assert Counter(map(tuple, without_substrings(df).collect())) == Counter((w[0], w[4]) for w in want)
        assert substring_digests(df.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_substrings(spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(w[:4] for w in plain(rows))


def test_repeats_and_long_texts(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(16))
    long = " ".join(str(rng.randrange(10**9)) for _ in range(60_000))
    rows = [(1, f"a {shared} b"), (2, f"c {shared} d"), (3, long), (4, f"{long} {shared}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring_digests(df).collect())) == Counter(w[:4] for w in plain(rows))
    found = repeats(df.where("doc_id < 3")).collect()
    assert found and all(r.words in shared and r.n_words == len(r.words.split()) >= 13 and r.n_places == 2 and r.least == 1 for r in found)
