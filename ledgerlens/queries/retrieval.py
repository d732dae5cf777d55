"""Vector search, fusion, boosting and the retrieval plan over the embeddings.

``vec_id div 4`` stands for a chunk's parent, ``vec_id % 50`` for its document, ``label`` for a metadata field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import calls
from ledgerlens.functions.text import STOPWORDS, bucket
from ledgerlens.operators import pruned, vector
from ledgerlens.plans import retrieve
from ledgerlens.providers import HashedTerms, RuleAnalyst
from ledgerlens.queries.relational import _text
from ledgerlens.session import scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


#: Query vectors: ones on every third, fourth and fifth place.
VARIANTS = [[float(i % n == 0) for i in range(64)] for n in (3, 4, 5)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "label", F.expr("vec_id div 4").alias("parent_id"), (F.col("vec_id") % 50).alias("document_id"), F.when(F.col("vec_id") % 5 != 0, F.col("vec_id") % 9).alias("start_page"))


def _dot(v: list[float]) -> str:
    return f"list_sum(list_transform(list_zip(embedding, {v}), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"


def _top(v: list[float], k: int, where: str = "true") -> str:
    return f"SELECT vec_id AS id, round({_dot(v)}, 6) AS score FROM embeddings WHERE {where} ORDER BY {_dot(v)} DESC, vec_id LIMIT {k}"


@query("dense_topk", _top(VARIANTS[0], 10))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.dense_top_k(_vectors(spark, sf_dir), VARIANTS[0], 10).select("id", F.round("score", 6).alias("score"))


@query("dense_topk_filtered", _top(VARIANTS[0], 10, "label = 3"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.dense_top_k(_vectors(spark, sf_dir), VARIANTS[0], 10, {"label": 3, "section": None}).select("id", F.round("score", 6).alias("score"))


_EACH = " UNION ALL ".join(f"SELECT {i} AS variant, vec_id AS id, {_dot(v)} AS score FROM embeddings" for i, v in enumerate(VARIANTS))
_LIST = f"e AS ({_EACH}), r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, id) AS rank FROM e QUALIFY rank <= 15), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY variant, rank) AS n FROM r QUALIFY n = 1), dense AS (SELECT id, score, row_number() OVER (ORDER BY variant, rank) AS pos FROM f)"


@query("multi_variant_dense", f"WITH {_LIST} SELECT id, round(score, 6) AS score, pos FROM dense")
def multi_variant_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.multi_variant_dense(_vectors(spark, sf_dir), VARIANTS).select("id", F.round("score", 6).alias("score"), F.col("pos").cast("bigint").alias("pos"))


#: Sparse vectors of the vectors: three terms each, by their ids.
_SPARSE = "SELECT vec_id AS id, (vec_id * k) % 97 AS idx, ln(1 + k) AS w FROM embeddings, (VALUES (1), (2), (3)) t(k)"
_TERMS = "(VALUES (5, 0.5), (10, 1.0), (15, 2.0)) q(idx, qw)"
_HYBRID = f"SELECT vec_id AS id, {_dot(VARIANTS[0])} + coalesce(s, 0) AS score FROM embeddings LEFT JOIN (SELECT id, sum(w * qw) AS s FROM ({_SPARSE}) JOIN {_TERMS} USING (idx) GROUP BY 1) x ON x.id = vec_id"


def _hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    index = rows.select("id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select("id", (F.col("id") * F.col("k") % 97).alias("idx"), F.log1p(F.col("k").cast("double")).alias("w"))
    terms = spark.createDataFrame([(5, 0.5), (10, 1.0), (15, 2.0)], "idx long, w double")
    return vector.hybrid_top_k(rows, index, VARIANTS[0], terms, k)


@query("hybrid_topk", f"SELECT id, round(score, 6) AS score FROM ({_HYBRID}) ORDER BY score DESC, id LIMIT 15")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 15).select("id", F.round("score", 6).alias("score"))


_FUSED = f"{_LIST}, bm25 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS pos FROM ({_HYBRID}) QUALIFY pos <= 15), lists AS (SELECT 'dense' AS label, 0 AS list, pos AS rank, id FROM dense UNION ALL SELECT 'bm25', 1, pos, id FROM bm25), fused AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf_score, list_sort(list(DISTINCT list)) AS ls FROM lists GROUP BY 1)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = vector.multi_variant_dense(_vectors(spark, sf_dir), VARIANTS).select(F.lit("dense").alias("label"), F.lit(0).alias("list"), F.col("pos").alias("rank"), "id")
    sparse = _hybrid(spark, sf_dir, 15).select(F.lit("bm25").alias("label"), F.lit(1).alias("list"), "rank", "id")
    return vector.rrf(dense.union(sparse))


_SOURCES = "array_to_string(list_transform(ls, lambda l: CASE l WHEN 0 THEN 'dense' ELSE 'bm25' END), '+')"


@query("rrf_fusion", f"WITH {_FUSED} SELECT id, round(rrf_score, 9) AS rrf_score, {_SOURCES} AS sources FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", "+").alias("sources"))


#: The graph's evidence: documents with pages.
EVIDENCE = [(4, [1, 2, 3]), (4, [3, 7]), (11, []), (23, [2, 5]), (37, [0, 8])]
_PAGES = "(SELECT d, list_distinct(flatten(list(p))) AS pages FROM (VALUES " + ", ".join(f"({d}, CAST({p} AS INTEGER[]))" for d, p in EVIDENCE) + ") v(d, p) GROUP BY 1)"
_MET = "e.d IS NOT NULL AND (id % 5 = 0 OR len(pages) = 0 OR list_contains(pages, CAST(id % 9 AS INTEGER)))"
_BOOSTED = f"{_FUSED}, boosted AS (SELECT id, rrf_score + CASE WHEN {_MET} THEN 0.1 ELSE 0 END AS rrf_score, {_SOURCES} || CASE WHEN {_MET} THEN '+kg_boost' ELSE '' END AS sources FROM fused LEFT JOIN {_PAGES} e ON e.d = id % 50)"


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fused(spark, sf_dir).join(_vectors(spark, sf_dir).drop("values"), "id")
    return vector.graph_boost(rows, spark.createDataFrame(EVIDENCE, "document_id long, pages array<long>"))


@query("kg_boost", f"WITH {_BOOSTED} SELECT id, round(rrf_score, 9) AS rrf_score, sources FROM boosted")
def kg_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boosted(spark, sf_dir).select("id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", "+").alias("sources"))


@query("parent_dedup", f"WITH {_BOOSTED} SELECT id, id // 4 AS parent_id, round(rrf_score, 9) AS rrf_score FROM boosted QUALIFY row_number() OVER (PARTITION BY id // 4 ORDER BY round(rrf_score, 9) DESC, id) = 1")
def parent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boosted(spark, sf_dir).withColumn("rrf_score", F.round("rrf_score", 9))
    return vector.best_of_parent(rows, position="id").select("id", "parent_id", "rrf_score")


@query("dense_tool_path", f"WITH t AS (SELECT vec_id AS id, {_dot(VARIANTS[1])} AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 15), d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY id // 4 ORDER BY score DESC, id) = 1) SELECT id, round(score, 6) AS score FROM d ORDER BY score DESC, id LIMIT 5")
def dense_tool_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """min(3k, 40) candidates, the best of each parent, k of these."""
    k = 5
    best = vector.best_of_parent(vector.dense_top_k(_vectors(spark, sf_dir), VARIANTS[1], min(3 * k, 40)), "score", "id")
    return best.orderBy(F.col("score").desc(), "id").limit(k).select("id", F.round("score", 6).alias("score"))


@query("index_stats", "SELECT label, count(*) AS vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings GROUP BY 1")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.index_stats(_vectors(spark, sf_dir), namespace="label")


@query("vector_upsert", "SELECT vec_id AS id, label, CASE WHEN label < 3 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE NOT (label < 3 AND embedding[1] < 0)")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds of labels below 3 is replaced, by vectors whose first number isn't negative."""
    index = _vectors(spark, sf_dir).withColumn("version", F.lit("old"))
    new = index.where((F.col("label") < 3) & (F.get("values", F.lit(0)) >= 0)).withColumn("version", F.lit("new"))
    return vector.upsert_document(index, vector.storable(new, ["label", "document_id"], 64), "label").select("id", "label", "version")


@query("vector_delete", "SELECT vec_id AS id FROM embeddings WHERE label <> 2")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.delete_where(_vectors(spark, sf_dir), {"label": 2}).select("id")


#: A question to chunks that have a vector of the embeddings and the text of the document with its id.
QUESTION = "the revenue of that region and other things"


def _terms(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-zA-Z0-9]+'), lambda t: length(t) >= 2 AND NOT list_contains([{', '.join(map(_text, STOPWORDS))}], t))"


_ASKED = RuleAnalyst().analyse(QUESTION).variants
_BUCKET = "CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % 2147483647"
_ONCE = "SELECT id, row_number() OVER (ORDER BY variant, rank) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY variant, rank) AS n FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, id) AS rank FROM {} QUALIFY rank <= 15) QUALIFY n = 1)"
_PIPELINE = f"""
    WITH c AS (SELECT vec_id AS id, vec_id // 4 AS parent_id, embedding, text, lang FROM embeddings JOIN documents ON vec_id = doc_id),
    v AS (SELECT * FROM (VALUES {', '.join(f"({i}, {_text(x)}, CAST({HashedTerms(64).embed(x)} AS DOUBLE[]))" for i, x in enumerate(_ASKED))}) t(variant, said, vec)),
    dense AS (SELECT variant, id, list_sum(list_transform(list_zip(embedding, vec), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS score FROM c, v WHERE upper(lang) = 'EN'),
    q AS (SELECT variant, {_BUCKET} AS idx, ln(1 + count(*)) AS qw FROM (SELECT variant, unnest({_terms('said')}) AS token FROM v) GROUP BY 1, 2),
    w AS (SELECT id, {_BUCKET} AS idx, ln(1 + count(*)) AS w FROM (SELECT id, unnest({_terms('text')}) AS token FROM c) GROUP BY 1, 2),
    sparse AS (SELECT id, variant, sum(w * qw) AS s FROM w JOIN q USING (idx) GROUP BY 1, 2),
    both_ AS (SELECT variant, id, score + coalesce(s, 0) AS score FROM dense LEFT JOIN sparse USING (id, variant)),
    lists AS (SELECT 0 AS list, 'dense' AS label, * FROM ({_ONCE.format('dense')}) UNION ALL SELECT 1, 'bm25', * FROM ({_ONCE.format('both_')})),
    fused AS (SELECT id, sum(1.0 / (60 + pos)) AS rrf, string_agg(label, '+' ORDER BY list) AS sources, min(list * 1000000 + pos) AS first FROM lists GROUP BY 1),
    placed AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, first) AS pos FROM fused JOIN c USING (id)),
    best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY rrf DESC, pos) = 1 ORDER BY rrf DESC, pos LIMIT 15),
    judged AS (SELECT *, list_distinct({_terms(_text(QUESTION))}) AS asked FROM best),
    scored AS (SELECT *, 1.0 + round(9 * (len(list_intersect(asked, {_terms('substr(text, 1, 2000)')})) / greatest(len(asked), 1)), 2) AS relevance FROM judged ORDER BY relevance DESC, rrf DESC, pos LIMIT 5),
    kept AS (SELECT *, list_filter(string_split(regexp_replace(substr(text, 1, 4500), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(list_intersect(asked, {_terms('x')})) > 0) AS found FROM scored)
    SELECT id, round(rrf, 9) AS rrf_score, sources, CAST(relevance AS DOUBLE) AS relevance_score, md5(CASE WHEN length(text) < 400 OR len(found) = 0 THEN text ELSE array_to_string(found, ' ') END) AS compressed FROM kept
"""


@query("retrieve_pipeline", _PIPELINE)
def retrieve_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = e.join(d, e.vec_id == d.doc_id)
    chunks = rows.select(F.col("vec_id").alias("id"), F.expr("vec_id div 4").alias("parent_id"), F.col("source").alias("document_id"), F.col("embedding").alias("values"), "text", F.col("text").alias("parent_text"), (F.col("vec_id") % 7).alias("start_page"), F.upper("lang").alias("ticker"))
    corpus = retrieve.Corpus(chunks, vector.sparse_index(rows, "vec_id", "text"))
    found = retrieve.Retriever(corpus, HashedTerms(64)).retrieve(QUESTION, filters={"ticker": "EN"})
    return found.select("id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", "+").alias("sources"), "relevance_score", F.md5("compressed_text").alias("compressed"))


@query("dense_index_topk", f"SELECT {0} AS q, * FROM ({_top(VARIANTS[0], 10)}) UNION ALL SELECT 1, * FROM ({_top(VARIANTS[2], 10)})")
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches of a stored index of cells, which skips those whose bound can't reach the tenth score."""
    folder = scratch(spark, "cells")
    pruned.store_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", folder, cells=64)
    first, second = (pruned.dense_search(spark, folder, VARIANTS[i], 10)[0].select(F.lit(q).alias("q"), "id", F.round("score", 6).alias("score")) for q, i in ((0, 0), (1, 2)))
    return first.union(second)


@query(
    "sparse_index_topk",
    "WITH q AS (SELECT vec_id, unnest(list_distinct([vec_id * 3 % 97, vec_id * 7 % 97])) AS idx FROM embeddings) SELECT vec_id AS id, CAST(count(*) AS DOUBLE) AS score FROM q WHERE idx IN (3, 30, 60, 90) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
)
def sparse_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of stored postings, which skips parts of the documents whose bound can't reach the last score."""
    folder = scratch(spark, "postings")
    words = lambda n: F.concat(F.lit("term"), (F.col("vec_id") * n % 97).cast("string"))
    docs = table(spark, sf_dir, "embeddings").select("vec_id", F.when(words(3) == words(7), words(3)).otherwise(F.concat_ws(" ", words(3), words(7))).alias("text"))
    pruned.store_postings(docs, "vec_id", "text", folder, part_docs=64)
    asked = spark.createDataFrame([(f"term{i}",) for i in (3, 30, 60, 90)], "token string").select(bucket(F.col("token")).alias("idx"), (F.lit(1.0) / F.log1p(F.lit(1.0))).alias("w"))
    return pruned.sparse_search(spark, folder, asked, 25)[0].select("id", F.round("score", 9).alias("score"))


def _model(request: str) -> str:
    """Stands for a model: its score is the length of the passage, modulo 11; it fails for passages that begin with a vowel."""
    passage = request.split("\nPassage: ", 1)[1].rsplit("\nAnswer", 1)[0]
    if passage[:1] in "AEIOU":
        raise OSError("the model is down")
    return f"Score: {len(passage) % 11} of 10"


_SEEN = "substr(text, 1, 2000)"


@query(
    "reranked_passages",
    f"SELECT source AS question, doc_id, score AS relevance_score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM (SELECT source, doc_id, CASE WHEN coalesce({_SEEN}, '') = '' OR {_SEEN}[1] IN ('A', 'E', 'I', 'O', 'U') THEN CAST(5 AS DOUBLE) ELSE greatest(1.0, CAST(length({_SEEN}) % 11 AS DOUBLE)) END AS score FROM documents WHERE text IS NOT NULL) t",
)
def reranked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is a question, its documents the passages; each different passage is asked about once, and failures count as 5."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("question"), "doc_id", "text")
    found = calls.reranked(rows, _model, calls.Policy(attempts=1))
    return found.select("question", "doc_id", "relevance_score", F.col("rank").cast("bigint").alias("rank"))


@query("fusion_explanation", f"WITH {_FUSED} SELECT id, printf('RRF score %.4f from %s (like rank %s in one list)', rrf_score, {_SOURCES}, CAST(round(1.0 / rrf_score - 60, 1) AS VARCHAR)) AS said FROM fused")
def fusion_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", vector.rrf_explanation(F.col("rrf_score"), F.col("sources")).alias("said"))


@query(
    "result_formatting",
    "SELECT doc_id AS pos, md5('Source: ' || source || CASE WHEN doc_id % 3 = 0 THEN ': ' || lang ELSE ', Unknown Section' END || ', Page ' || doc_id % 7 || ' (Relevance: ' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 10 + 1 AS VARCHAR) ELSE '?' END || '/10)' || chr(10)"
    " || CASE WHEN doc_id % 5 = 0 THEN 'short' ELSE text END || chr(10) || 'Matched: ' || CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END) AS shown FROM documents WHERE regexp_matches(text, '\\S') AND lang IS NOT NULL",
)
def result_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & F.col("lang").isNotNull()).select(
        d.alias("pos"), F.col("source").alias("source_name"), F.when(d % 3 == 0, F.col("lang")).otherwise("").alias("headline"), F.lit("reference").alias("document_type"), (d % 7).cast("string").alias("start_page"),
        F.when(d % 2 == 0, d % 10 + 1).alias("relevance_score"), F.when(d % 5 == 0, "short").otherwise("").alias("compressed_text"), F.lit("").alias("parent_text"), "text",
    )
    return retrieve.formatted(rows).select("pos", F.md5("shown").alias("shown"))


@query("out_of_scope", "SELECT source, lang, max(doc_id % 11 * 0.5) < 3 AND bool_and(n_chars > 700) AS out_of_scope FROM documents GROUP BY 1, 2")
def out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and language as a question, its documents as what was found for it."""
    found = table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 11 * 0.5).alias("relevance_score"), (F.col("n_chars") > 700).alias("compression_skipped"))
    return retrieve.out_of_scope(found, ["source", "lang"])


@query("expected_sources", f"WITH t AS (SELECT vec_id % 50 AS d, {_dot(VARIANTS[0])} AS score FROM embeddings ORDER BY 2 DESC LIMIT 3) SELECT CASE WHEN max(score) >= 0.6 THEN 'PASS' WHEN max(score) IS NOT NULL THEN 'WEAK' ELSE 'FAIL' END AS verdict FROM t WHERE d = 7")
def expected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.dense_top_k(_vectors(spark, sf_dir), VARIANTS[0], 10)
    return retrieve.expected_source(found.withColumn("document_id", F.col("document_id").cast("string")), "7")


