from __future__ import annotations

import hashlib
import random
import re

import pytest

from ledgerlens.llm.decontam import BLOCK_BYTES, Windows, _parts, contamination, decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[at : at + n]))) is not None:
                    found |= s
                    hit[at : at + n] = [1] * n
        h = sum(hit)
        out.append((i, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "été", "42", "x", "日本", "omega", "delta", "word", "Ⅷ"]
    item = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, item(rng.choice([13, 14, 30]))) for i in range(30)] + [(50, "Just-three  words"), (51, "one"), (52, ""), (53, None), (None, item(13)), (54, "!!"), (2, item(20))]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choices([*vocabulary, "noise", "more"], k=rng.randrange(40)))]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(2), (rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n"])))
        if rng.random() < 0.3:
            parts.append("filler text " * 300)
        docs.append((i, " ".join(parts)))
    return [*docs, (900, None), (901, ""), (902, "y " * 50_000), (903, "just three words"), (903, "just three words"), (None, "ONE")], items


def test_contamination(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, spans string")
    key = lambda r: (r[0] is None, r)
    for block_bytes in (BLOCK_BYTES, 2_500):
        assert sorted((tuple(r) for r in contamination(df, bench, block_bytes).collect()), key=key) == sorted(plain(docs, items), key=key)
    assert contamination(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in contamination(df, bench.limit(0)).collect())


def cut(text, hit):
    """Word by word: what stands before, between and after words that stay."""
    if text is None:
        return None
    out, at, gone = "", 0, False
    for m, h in zip(WORD.finditer(text.translate(LOWER)), hit, strict=True):
        if not h or not gone:
            out += text[at : m.start()]
        if not h:
            out += m[0] if text.isascii() and text.islower() else text[m.start() : m.end()]
        at, gone = m.end(), bool(h)
    return out + text[at:]


@pytest.mark.parametrize("block_bytes", [BLOCK_BYTES, 2_500])
def test_removal(spark, block_bytes):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, _row int, _found int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = sorted(str(i) for i, *_, bad in plain(docs, items) if not bad)
    left = decontaminate(df, bench, block_bytes=block_bytes)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == clean
    spans = sorted(((str(r.doc_id), r.text) for r in decontaminate(df, bench, how="spans", block_bytes=block_bytes).collect()), key=str)
    assert spans == sorted(((str(i), cut(t, marks(t, items))) for i, t in docs), key=str)


def marks(text, items):
    w = words(text)
    hit = [0] * len(w)
    for _, t in items:
        x = words(t)
        n = min(13, len(x))
        held = {tuple(x[at : at + n]) for at in range(len(x) - n + 1)} if n else set()
        for at in range(len(w) - n + 1 if n else 0):
            if tuple(w[at : at + n]) in held:
                hit[at : at + n] = [1] * n
    return hit


def test_overlapping_windows_of_many_blocks(spark):
    """Windows that overlap, each in a block of its own, cut what one block would cut."""
    w = [f"w{k}" for k in range(20)]
    text = "keep " + " ".join(w) + " tail"
    bench = spark.createDataFrame([(k, " ".join(w[k : k + 13])) for k in range(8)], "item_id long, text string")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for block_bytes in (BLOCK_BYTES, 1):
        assert [r.text for r in decontaminate(df, bench, how="spans", block_bytes=block_bytes).collect()] == ["keep  tail"]


def test_blocks_are_bounded_and_cut_long_items():
    """An item of 100,000 words in blocks of 40 kB: no block has more, and no window is lost."""
    text = " ".join(f"w{k}" for k in range(100_000))
    blocks = [Windows(p) for p in _parts([("1", "short item"), ("2", text), ("3", "a b c")], 40_000)]
    assert len(blocks) > 80
    for b in blocks:
        assert b.words.nbytes + b.known.nbytes + sum(a.nbytes for s in b.sets.values() for a in s) <= 40_000
    assert sum(len(s[0]) for b in blocks for n, s in b.sets.items() if n == 13) == 100_000 - 12
    assert {n for b in blocks for n in b.sets} == {2, 3, 13}
