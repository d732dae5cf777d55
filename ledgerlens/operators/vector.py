"""Dense, sparse and hybrid scoring, top-k, rank fusion, boosting and de-duplication.

Ranks are columns, since rows have no order. Where the best few of many are wanted, they
are taken by ``orderBy().limit()``, which each task does for itself before one merge, or
by an aggregate that keeps the best ``k`` in each task; no list is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import bucket, tokens

#: Fixed values of fusion, boosting and candidate lists.
RRF_K, BOOST, DENSE_TOP, SPARSE_TOP, CANDIDATES = 60, 0.1, 15, 15, 15
METADATA_BYTES = 38 * 1024


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def term_weights(text: Column) -> Column:
    """Sparse vector of a text: (idx, w) with w = ln(1 + count) for each term, in order of first occurrence."""
    terms = F.transform(tokens(text), bucket)
    return F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("idx"), F.log1p(F.size(F.filter(terms, lambda u: u == t)).cast("double")).alias("w")))


def sparse_index(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame | None = None) -> DataFrame:
    """(id, idx, w): the same as rows, counted by an aggregate, which long texts need. With ``asked`` (idx), a question's few terms, only those: others go before anything is counted."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token")).select("id", bucket(F.col("token")).alias("idx"))
    if asked is not None:
        terms = terms.join(F.broadcast(asked.select("idx").distinct()), "idx", "left_semi")
    counts = terms.groupBy("id", "idx").agg(F.count("*").alias("n"))
    return counts.select("id", "idx", F.log1p(F.col("n").cast("double")).alias("w"))


def equal_to(filters: dict[str, object] | None) -> Column:
    """The conjunction of equalities with all values that aren't None."""
    out = F.lit(True)
    for name, value in (filters or {}).items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def search_filters(ticker: str | None = None, document_type: str | None = None, section: str | None = None) -> dict[str, str]:
    found = {"ticker": ticker and ticker.upper(), "document_type": document_type and document_type.lower(), "section": section}
    return {k: v for k, v in found.items() if v}


def top_k(scored: DataFrame, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The ``k`` best rows with their ``rank``; ties go to smaller ids. The rank is taken over ``k`` rows only."""
    best = scored.orderBy(F.col(score).desc_nulls_last(), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), id_col)))


def dense_top_k(vectors: DataFrame, query: list[float], k: int = 10, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """Best by dot product among the rows that meet the filters; these are applied, and pushed down, before scoring."""
    return top_k(vectors.where(equal_to(filters)).withColumn("score", dot(F.col(vector_col), vector(query))), k, id_col=id_col)


def sparse_scores(index: DataFrame, query: DataFrame) -> DataFrame:
    """(id, sparse): dot products with the query's (idx, w), for rows that share a term with it.

    The query's few terms are broadcast, so the index is filtered where it is read.
    """
    hits = index.join(F.broadcast(query.select("idx", F.col("w").alias("qw"))), "idx")
    return hits.groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("sparse"))


def hybrid_top_k(vectors: DataFrame, index: DataFrame, query: list[float], terms: DataFrame, k: int = 10, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """Best by the sum of the dense and the sparse dot product, weights not being negative.

    A row without sparse hits that is among the best has fewer than ``k`` rows of a better dense score before it, so it is among the ``k`` best dense ones. Besides
    these only rows with hits are looked at, and the vectors aren't shuffled to add a few hits unless there are too many to broadcast.
    """
    dense = vectors.where(equal_to(filters)).withColumn("dense", dot(F.col(vector_col), vector(query)))
    hits = sparse_scores(index, terms).withColumnRenamed("id", id_col)
    met = dense.join(hits, id_col).withColumn("score", F.col("dense") + F.col("sparse"))
    first = dense.withColumns({"sparse": F.lit(None).cast("double"), "score": F.col("dense")}).orderBy(F.col("dense").desc_nulls_last(), id_col).limit(k)
    return top_k(met.unionByName(first.join(hits.select(id_col), id_col, "left_anti")), k, id_col=id_col)


def top_k_by_variant(scored: DataFrame, k: int, variant: str = "variant", score: str = "score", id_col: str = "id") -> DataFrame:
    """The ``k`` best of each variant with ``rank``. A task passes on no more than its own ``k`` of each (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(variant).orderBy(F.col(score).desc_nulls_last(), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def joined_variants(ranked: DataFrame, variant: str = "variant", id_col: str = "id") -> DataFrame:
    """Lists of variants, one after the other, as one list: each id where it comes first, with ``pos`` from 1."""
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(variant, "rank"))
    once = ranked.withColumn("_n", first).where("_n = 1").drop("_n")
    return once.withColumn("pos", F.row_number().over(Window.orderBy(variant, "rank")))


def multi_variant_dense(vectors: DataFrame, variants: list[list[float]], k: int = DENSE_TOP, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """Dense search for each of a few query variants, scored in one pass over the vectors."""
    scores = F.array(*(F.struct(F.lit(i).alias("variant"), dot(F.col(vector_col), vector(v)).alias("score")) for i, v in enumerate(variants)))
    each = vectors.where(equal_to(filters)).select("*", F.explode(scores).alias("_s")).select(*vectors.columns, "_s.variant", "_s.score")
    return joined_variants(top_k_by_variant(each, k, id_col=id_col), id_col=id_col)


def rrf(lists: DataFrame, k: int = RRF_K, id_col: str = "id") -> DataFrame:
    """Reciprocal rank fusion of rows (label, list, rank, id): (id, rrf_score, sources, pos).

    Labels stay with their lists even if some list is empty. Rows without an id are left out, but their rank is used up. Sources
    come in order of lists; equal scores in order of first appearance.
    """
    merged = lists.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("rrf_score"),
        F.array_sort(F.collect_set(F.struct("list", "label"))).alias("_s"),
        F.min(F.struct("list", "rank")).alias("_first"),
    )
    out = merged.select(id_col, "rrf_score", F.transform("_s", lambda s: s["label"]).alias("sources"), "_first")
    return out.withColumn("pos", F.row_number().over(Window.orderBy(F.col("rrf_score").desc(), "_first"))).drop("_first")


def rrf_explanation(score: Column, sources: Column, k: int = RRF_K) -> Column:
    """One line on how a fused score came about."""
    best = F.round(F.lit(1.0) / score - k, 1)
    return F.format_string("RRF score %.4f from %s (like rank %s in one list)", score, F.array_join(sources, "+"), best.cast("string"))


def graph_boost(fused: DataFrame, evidence: DataFrame, by_page: bool = True, boost: float = BOOST) -> DataFrame:
    """Adds ``boost`` once to chunks (document_id, start_page) that the graph's evidence (document_id, pages) points to.

    With ``by_page``, a chunk counts if its page is among the pages, or has none; otherwise any of a document does.
    """
    pages = evidence.groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("pages"))).alias("_pages"))
    rows = fused.join(pages, "document_id", "left")
    met = F.col("_pages").isNotNull()
    if by_page:
        met = met & (F.col("start_page").isNull() | (F.size("_pages") == 0) | F.coalesce(F.array_contains("_pages", F.col("start_page")), F.lit(False)))
    label = F.array(F.lit("kg_boost"))
    return rows.withColumns({"rrf_score": F.col("rrf_score") + F.when(met, F.lit(boost)).otherwise(0.0), "sources": F.when(met, F.array_union("sources", label)).otherwise(F.col("sources"))}).drop("_pages")


def best_of_parent(rows: DataFrame, score: str = "rrf_score", position: str = "pos", parent: str = "parent_id") -> DataFrame:
    """The best chunk of each parent, the earliest of equals."""
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.col(score).desc_nulls_last(), position))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


def multi_variant_hybrid(vectors: DataFrame, index: DataFrame, variants: list[list[float]], terms: DataFrame, k: int = SPARSE_TOP, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """Hybrid search for each of a few query variants, terms given as (variant, idx, w): one pass over the vectors and one over the index."""
    hits = index.join(F.broadcast(terms.select("variant", "idx", F.col("w").alias("qw"))), "idx").groupBy(F.col("id").alias(id_col), "variant").agg(F.sum(F.col("w") * F.col("qw")).alias("sparse"))
    scores = F.array(*(F.struct(F.lit(i).alias("variant"), dot(F.col(vector_col), vector(v)).alias("dense")) for i, v in enumerate(variants)))
    each = vectors.where(equal_to(filters)).select(id_col, F.explode(scores).alias("_s")).select(id_col, "_s.variant", "_s.dense")
    both = each.join(hits, [id_col, "variant"], "left").withColumn("score", F.col("dense") + F.coalesce("sparse", F.lit(0.0)))
    return joined_variants(top_k_by_variant(both, k, id_col=id_col), id_col=id_col)


def storable(records: DataFrame, metadata: list[str], dimension: int, values: str = "values") -> DataFrame:
    """Records whose vectors have the index's dimension and whose metadata isn't too large to store."""
    size = F.octet_length(F.to_json(F.struct(*metadata)))
    return records.where((F.size(values) == dimension) & (size <= METADATA_BYTES))


def upsert_document(index: DataFrame, records: DataFrame, key: str = "document_id") -> DataFrame:
    """The index with the documents in ``records`` replaced as a whole. No records, no change."""
    return index.join(records.select(key).distinct(), key, "left_anti").unionByName(records, allowMissingColumns=True)


def delete_where(index: DataFrame, filters: dict[str, object]) -> DataFrame:
    if not any(v is not None for v in filters.values()):
        raise ValueError("a filter is needed to delete by")
    return index.where(~F.coalesce(equal_to(filters), F.lit(False)))


def index_stats(index: DataFrame, values: str = "values", namespace: str | None = None) -> DataFrame:
    named = index.groupBy(*([namespace] if namespace else []))
    return named.agg(F.count("*").alias("vectors"), F.max(F.size(values)).alias("dimension"))
