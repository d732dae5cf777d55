"""Batch jobs over extracted documents: the vector index, the graph, and the metrics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import is_10k, ticker_of_filing, ticker_of_parts
from ledgerlens.operators import chunking, entities, graph, load, vector
from ledgerlens.providers import HashedTerms

VERSION = "v3_hybrid"


def document_metadata(documents: DataFrame) -> DataFrame:
    """(document_id, document_type, company, ticker, fiscal_year, total_pages, ...): nested values, the ticker out of the id if need be."""
    m = F.col("metadata")
    return documents.select(
        "document_id",
        F.when(is_10k(F.lit(None).cast("string"), F.col("document_type")), "10k").otherwise("reference").alias("document_type"),
        m["company"].alias("company"),
        F.coalesce(F.nullif(m["ticker"], F.lit("")), ticker_of_parts(F.col("document_id"))).alias("ticker"),
        F.coalesce(m["fiscal_year"], F.get(F.split("document_id", "_"), F.lit(2)).try_cast("int")).alias("fiscal_year"),
        "total_pages",
        F.coalesce(m["source_type"], F.lit("document")).alias("source_type"),
        m["source"].alias("source_name"),
        m["publication_date"].alias("publication_date"),
        m["headline"].alias("headline"),
    )


def vector_records(documents: DataFrame, embedder: HashedTerms | None = None, parent: int = chunking.PARENT, child: int = chunking.CHILD, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Records of all children: id, vector, sparse vector, texts and metadata."""
    chunking.check_sizes(parent, child, overlap)
    embedder = embedder or HashedTerms()
    pages = load.with_text(load.page_rows(documents))
    parents = chunking.chunk_documents(pages, parent, overlap)
    metadata = document_metadata(documents)
    children = chunking.enriched(chunking.children_of(parents, child, overlap), metadata)
    rows = children.join(parents.select("parent_id", F.col("text").alias("parent_text"), "parent_index"), "parent_id")
    return rows.select(
        F.col("child_id").alias("id"), embedder.column(F.col("text")).alias("values"), vector.term_weights(F.col("text")).alias("sparse"), "text", "text_raw", "parent_text", "parent_index",
        *[c for c in children.columns if c not in ("child_id", "text", "text_raw", "total_pages")], "total_pages",
    )


def indexed(index: DataFrame, manifest: DataFrame, documents: DataFrame, force: bool = False, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """The index with all documents that need it indexed anew, and a manifest row (doc_id, chunk_count, parent_count, version) for each."""
    wanted = load.to_index(manifest, documents.withColumn("doc_id", F.col("document_id")), VERSION, force).drop("doc_id")
    records = vector_records(wanted, **sizes)
    done = records.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").cast("int").alias("chunk_count"), F.countDistinct("parent_id").cast("int").alias("parent_count"))
    return vector.upsert_document(index, records), done.withColumn("index_schema_version", F.lit(VERSION)).withColumn("indexed", F.lit(True))


def graph_of(documents: DataFrame, patterns: DataFrame, recogniser: entities.Recogniser | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, type, text, mention_count, ...) and mentions (document_id, entity_id, page) of documents."""
    pages = _pages(documents)
    return _graph(entities.found_entities(pages, patterns, recogniser))


def _pages(documents: DataFrame) -> DataFrame:
    return load.with_text(load.page_rows(documents)).select("document_id", F.col("page_number").alias("page"), "text")


def _graph(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = given.withColumns({"confidence": F.lit(1.0), "source_document": F.col("document_id")})
    once = graph.merged_by_text(found, ["page", "position"], keys=["document_id", "page"]).withColumn("source_document", F.col("document_id"))
    none = once.select("type", "text", F.lit(0).cast("bigint").alias("mention_count"), "source_document", "confidence").limit(0)
    known = graph.merged_entities(none, once).withColumn("entity_id", F.sha2(F.concat_ws("\u0001", "type", "text"), 256))
    mentions = graph.merged_mentions(once.select("document_id", F.lit(None).cast("string").alias("entity_id"), "page").limit(0), known, once.select("document_id", "text", "page"))
    return known, mentions


def entity_index(documents: DataFrame, known: DataFrame, patterns: DataFrame, recogniser: entities.Recogniser | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and mentions of the documents that the graph (``known``: document_id) doesn't hold yet, and the run's statistics."""
    wanted = entities.needs_entities(documents, known, force)
    pages = _pages(wanted)
    found = entities.found_entities(pages, patterns, recogniser)
    nodes, mentions = _graph(found)
    return nodes, mentions, entities.indexing_statistics(documents, wanted, pages, found, mentions)


def metrics_tables(documents: DataFrame, companies: DataFrame) -> dict[str, DataFrame]:
    """New rows of the four metrics tables, of filings whose company is known by ticker."""
    filings = documents.where(is_10k(F.lit(None).cast("string"), F.col("document_type")))
    pages = load.page_rows(filings)
    own = filings.select("document_id", ticker_of_filing(F.col("document_id")).alias("ticker")).join(companies.select(F.col("id").alias("company_id"), "ticker"), "ticker").select("document_id", "company_id")
    out = {"financial_metrics": load.clean_metrics(load.metrics_by_year(pages))}
    out["segment_revenue"] = load.distinct_items(pages, "segment_data", "segment_name")
    out["geographic_revenue"] = load.distinct_items(pages, "geographic_data", "region")
    out["risk_factors"] = load.distinct_items(pages, "risk_factors", "title", year=False).withColumn("severity", load.clean_severity(F.col("severity"))).withColumnRenamed("source_page", "page_number")
    return {name: df.join(own, "document_id").drop("document_id") for name, df in out.items()}
