from __future__ import annotations

import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlens.llm import langid
from ledgerlens.llm.queries import language_model

from . import test_decontam, test_linededup, test_simhash

SF = "/root/testdata/sf0.001"


def test_equals_plain_version(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spoken = {r.doc_id for r in langid.predictions(docs, language_model(docs)).where("lang_pred <> 'und'").collect()}
    kept = {i: t for i, t, *_ in test_linededup.plain([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in spoken])}
    groups = test_simhash.groups({i: test_simhash.plain(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    bad = {i for i, *_, c in test_decontam.plain(list(kept.items()), bench) if c}
    kept = {i: t for i, t in kept.items() if i not in bad}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and bad


def test_unlabelled_documents_are_packed(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "!!! 123", None, None, 7), (-2, None, None, None, 0), (-3, "", None, None, 0)], docs.schema)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.withColumn("lang", F.lit(None).cast("string")).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted((r.doc_id, r.length) for r in corpus_pipeline.run(spark, sf).collect()) for sf in (str(tmp_path), SF))
    assert got == want and got


def test_language_stage_rejects_by_letters_alone(spark):
    rows = [(i, t, lang) for i in range(30) for t, lang in ((f"words {i}", None), ("42 !", None), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    late = docs.withColumn("lang", F.when(langid.held_out(), "en"))
    for given in (docs, late, docs.withColumn("lang", F.lit("und"))):
        got = corpus_pipeline.identify_language(spark, given, SF).collect()
        assert sorted(r.doc_id for r in got) == list(range(30)) and all(r.text.startswith("words") for r in got)


def test_language_stage_names_the_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = docs.withColumn("lang", F.when(~langid.held_out(), F.col("lang")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, hidden, SF).collect()}
    true = {r.doc_id: r.lang for r in docs.where(langid.held_out() & F.col("lang").isNotNull()).collect() if r.doc_id in got}
    assert len(true) > 30 and sum(got[i] == x for i, x in true.items()) > 0.97 * len(true)
    plain = {r.doc_id: r.lang for r in docs.where(~langid.held_out() & F.col("lang").isNotNull()).collect() if r.doc_id in got}
    assert all(got[i] == x for i, x in plain.items())


def test_stages_keep_clashing_columns_and_very_long_texts(spark):
    words = " ".join(f"word{i}" for i in range(2_000_000))
    rows = [(1, f"{words}.\nThe line that both of them have.", "en", "s", 5, "a", 1, "x", 2), (2, "The line that both of them have.\nAnd one more line of its own.", None, "s", 5, "b", 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _gone int, _row string, _number int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 2} and got[2].text == "And one more line of its own." and len(got[1].text) > 20_000_000 and got[1]._id == "a"


def test_near_stage_keeps_one_of_each_group(spark):
    text = "some words that make up a text of a few shingles in all"
    rows = [(3, text, "en", "s", 1), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (2, text.upper(), "en", "s", 1), (2, text.upper(), "en", "s", 1), (9, "other words altogether", None, None, None), (None, "alone without id", "en", "s", 1), (None, "alone without id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.dedup_near(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id) for r in got.collect())) == ["2", "9", "None"]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
