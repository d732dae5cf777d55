from __future__ import annotations

import random

import xxhash

from ledgerlens.llm.simhash import close_pairs, fingerprint, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """fps: id -> fingerprint; id -> smallest id reachable."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j > i and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_plain_one():
    texts = [None, "", " \t\n", "one", "One two", "a b c", "a b c d", "É É é straße X", "w x y z q", "a b c " * 9000, "x\x1cy \x85 z"]
    assert [fingerprint(t) & (2**64 - 1) for t in texts] == [plain(t) for t in texts]


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=rng.choice([1, 2, 4, 40, 90])) for _ in range(25)]
    texts = {}
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[i * 3] = " ".join(t)
    texts |= {1000: None, 1001: "", 1002: "  "}
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    want = groups({i: plain(t) for i, t in texts.items()})
    for bucket in (64, 1):
        got = {r.doc_id: r for r in near_duplicates(df, bucket=bucket).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(int(r.fingerprint, 16) == plain(texts[i]) for i, r in got.items())


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(4) << 3 | rng.getrandbits(3) << 60 | 7 << 30 for _ in range(90)} | {0, 1, 1 << 63}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    ids = {f: f & (2**64 - 1) for f in fps}
    for bucket in (4, 1000):
        edges = {(r.a, r.b) for r in close_pairs(df, bucket).collect()}
        assert all((ids[a] ^ ids[b]).bit_count() <= 2 for a, b in edges)
        root = dict(zip(fps, fps, strict=True))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        want = groups(ids)
        for a in fps:
            for b in fps:
                assert (find(a) == find(b)) == (want[a] == want[b])


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A  B C"), (None, None)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert len(got) == 5
    assert {r.component_id for r in got if r.fingerprint != "0" * 16} == {2}
