from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq

from ledgerlens.llm import langid
from ledgerlens.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op7_language_id(spark, SF).collect()}
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    judged = [got[r["doc_id"]].lang_pred == r["lang"] for r in rows if got[r["doc_id"]].held_out and r["lang"]]
    assert len(judged) > 250 and np.mean(judged) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_masks_hold_all_languages():
    rng = np.random.default_rng(0)
    for count in (3, 12, 70):
        grams = rng.integers(0, 2**32, 3000)
        lang = rng.integers(0, count, 3000)
        model = langid.LanguageModel.of([f"l{i:02}" for i in range(count)], "l00", grams, lang)
        cells = [np.bitwise_and.reduce([t[c] for c in model._cells(grams, len(t))]) for t in model.slices]
        for value, which in zip(zip(*cells, strict=True), lang.tolist(), strict=True):
            assert int(value[which // 64]) >> (which % 64) & 1
        assert (model.false < 0.2).all()


def test_grams_keep_to_their_texts():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab  ", k=rng.randrange(12))) for _ in range(200)]
    values, owner = langid.grams(texts)
    got = sorted(zip(owner.tolist(), values.tolist(), strict=True))
    want = []
    for i, t in enumerate(texts):
        padded = b"   " + t + b"   "
        want += [(i, int.from_bytes(padded[k : k + 4])) for k in range(len(padded) - 3) if b"  " not in padded[k : k + 4]]
    assert got == sorted(want)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 0), (2, None, "en", 0), (3, "", "fr", 0), (4, "le chat et le chien", "fr", 0), (None, "the 42", None, 0), (5, "!!! 123", "en", 0), (5, "!!! 123", "en", 0), (6, "x", "en", 0), (7, "the " * 60_000, "en", 0), (8, "日本", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.learn(docs)
    got = {r.doc_id: r for r in langid.predictions(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None, 5, 6, 7, 8)] == ["en", "und", "und", "fr", "en", "und", "en", "en", "en"]
    assert got[2].score == got[5].score == got[8].score == 0 and not got[None].held_out
    assert sorted(str(r.doc_id) for r in langid.identified(docs, model).collect()) == sorted(["1", "4", "None", "6", "7", "8"])
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.predictions(docs, empty).collect()} == {"und"}
    assert langid.predictions(docs.limit(0), model).count() == 0
