"""Consolidation of extracted pages, validation, and changes of tables.

Tables are changed by plans that make the new table out of the old one and the new rows, to be
written over it: keyed unions with the newest row kept, anti joins for what goes. "Latest" and
"first" are aggregates over an explicit order, which combine before the shuffle, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import safe_decimal
from ledgerlens.schema import EPS, EPS_COLUMNS, METRIC_COLUMNS, MONEY, MONEY_COLUMNS, PERCENT

#: The severities a risk may have.
SEVERITIES = ["high", "medium", "low"]


# Consolidation


def last_known(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key, every column's value on the last row that has one."""
    return rows.groupBy(*keys).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def first_of(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of each key, the columns of its first row. Null keys are keys."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_f")
    return rows.groupBy(*keys).agg(first).select(*keys, "_f.*")


def page_rows(documents: DataFrame) -> DataFrame:
    """One row for each page of extracted documents, null texts and all."""
    return documents.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.*")


def with_text(pages: DataFrame, text: str = "text") -> DataFrame:
    return pages.where(F.col(text).rlike(r"\S"))


def metrics_by_year(pages: DataFrame) -> DataFrame:
    """(document_id, fiscal_year, ...metrics): later pages win, but for what they leave out."""
    rows = pages.where("financial_metrics.fiscal_year IS NOT NULL").select("document_id", "page_number", "financial_metrics.*")
    return last_known(rows, ["document_id", "fiscal_year"], "page_number", METRIC_COLUMNS)


def distinct_items(pages: DataFrame, column: str, name: str, year: bool = True) -> DataFrame:
    """Segments, regions or risks of a document, each once as on its first page, with ``source_page``."""
    items = pages.select("document_id", "page_number", F.posexplode(column).alias("_at", "i")).select("document_id", F.col("page_number").alias("source_page"), "_at", "i.*")
    keys = ["document_id", name, *(["fiscal_year"] if year else [])]
    rest = [c for c in items.columns if c not in (*keys, "_at")]
    return first_of(items.where(F.col(name).isNotNull()), keys, ["source_page", "_at"], rest)


def by_revenue(items: DataFrame, *ties: str) -> DataFrame:
    """The greatest revenue first, none counting as zero; ties in order of other columns."""
    return items.orderBy(F.coalesce("revenue", F.lit(0)).desc(), *ties)


def reference_documents(pages: DataFrame) -> DataFrame:
    """One row for each reference document: page 1's scalars, all claims with their page, all entities in order."""
    first = lambda c: F.max(F.when(F.col("page_number") == 1, F.col(c))).alias(c)
    claims = F.transform(F.coalesce("key_claims", F.array().cast("array<struct<claim:string,entities:array<string>>>")), lambda c: F.struct(F.col("page_number").alias("source_page"), c["claim"].alias("claim")))
    return pages.groupBy("document_id").agg(
        *(first(c) for c in ("headline", "publication_date", "source")),
        F.flatten(F.array_sort(F.collect_list(claims))).alias("key_claims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("entities_mentioned", F.array().cast("array<string>")))))).alias("entities_mentioned"),
    )


def clean_metrics(rows: DataFrame) -> DataFrame:
    """Extracted numbers or texts as the table's decimals; what is no number, or too large, is null."""
    kinds = {c: MONEY for c in MONEY_COLUMNS} | {c: EPS for c in EPS_COLUMNS}
    return rows.withColumns({c: safe_decimal(F.col(c).cast("string"), kinds.get(c, PERCENT)) for c in METRIC_COLUMNS if c in rows.columns})


def clean_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin(*SEVERITIES), low)


def load_warnings(metrics: Column, segments: Column, regions: Column, risks: Column, filing: Column) -> Column:
    """What an extraction lacks, as texts; a revenue or income of 0 counts as missing. Only filings are judged further.

    ``metrics`` is an array of structs with fiscal_year, revenue and net_income; the others are counts.
    """
    missing = lambda c, what: F.transform(F.filter(metrics, lambda m: F.coalesce(m[c], F.lit(0)) == 0), lambda m: F.concat(F.lit(f"Missing {what} for year "), m["fiscal_year"].cast("string")))
    some = lambda n, text: F.when(F.coalesce(n, F.lit(0)) == 0, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        some(F.size(metrics), "No financial metrics"),
        missing("revenue", "revenue"),
        missing("net_income", "net_income"),
        some(segments, "No segment revenue"),
        some(regions, "No geographic revenue"),
        some(risks, "No risk factors"),
    )
    return F.when(filing, found).otherwise(F.array(F.lit("Not a 10-K document")))


# Changes of tables


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows by key, new ones over old ones with all their columns, nulls too; of new rows of a key, the last by ``order``."""
    columns = [c for c in old.columns if c not in keys]
    rank = F.struct(F.lit(1).alias("n"), (F.col(order) if order else F.lit(0)).alias("o"))
    kind = new.select(rank.alias("r")).schema["r"].dataType
    before = old.select(*keys, F.lit(None).cast(kind).alias("_r"), F.struct(*columns).alias("_v"))
    after = new.select(*keys, rank.alias("_r"), F.struct(*(F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns)).alias("_v"))
    return before.union(after).groupBy(*keys).agg(F.max_by("_v", F.coalesce("_r", F.struct(F.lit(0).alias("n"), F.lit(None).cast(kind["o"].dataType).alias("o")))).alias("_v")).select(*keys, "_v.*").select(*old.columns)


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by ticker; what a new row leaves null stays as it was, and a missing name becomes the ticker."""
    both = old.alias("o").join(new.alias("n"), F.upper("o.ticker") == F.upper("n.ticker"), "full")
    columns = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns if c not in ("ticker", "name")]
    ticker = F.coalesce("o.ticker", F.upper("n.ticker"))
    return both.select(ticker.alias("ticker"), F.coalesce("n.name", "o.name", ticker).alias("name"), *columns).select(*old.columns)


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All old rows of the keys that ``new`` has go; its own come in."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def cascade_delete(companies: DataFrame, children: dict[str, DataFrame], ticker: str) -> dict[str, DataFrame]:
    """The tables without a company, and without the rows that refer to it."""
    gone = companies.where(F.upper("ticker") == ticker.upper()).select(F.col("id").alias("company_id"))
    kept = {"companies": companies.where((F.upper("ticker") != ticker.upper()) | F.col("ticker").isNull())}
    return kept | {name: df.join(gone, "company_id", "left_anti").select(*df.columns) for name, df in children.items()}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, rows): how many rows of the five tables break a key, reference or check."""
    def count(rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")

    companies = tables["companies"]
    out = count("companies.ticker unique", companies.groupBy("ticker").count().where("count > 1"))
    out = out.union(count("financial_metrics unique by year", tables["financial_metrics"].groupBy("company_id", "fiscal_year").count().where("count > 1")))
    for name in ("financial_metrics", "segment_revenue", "geographic_revenue", "risk_factors"):
        out = out.union(count(f"{name}.company_id refers", tables[name].join(companies.select(F.col("id").alias("company_id")), "company_id", "left_anti")))
    return out.union(count("risk_factors.severity", tables["risk_factors"].where(~F.col("severity").isin(*SEVERITIES))))


# Manifest


def to_process(manifest: DataFrame, files: DataFrame, force: bool = False, if_changed: bool = False) -> DataFrame:
    """Files (doc_id, file_hash) to extract: unknown ones, with ``if_changed`` those whose hash differs, with ``force`` all."""
    known = manifest.select("doc_id", F.col("file_hash").alias("_h"), F.lit(True).alias("_k"))
    wanted = F.lit(force) | F.col("_k").isNull() | (F.lit(if_changed) & ~F.col("file_hash").eqNullSafe(F.col("_h")))
    return files.join(known, "doc_id", "left").where(wanted).select(*files.columns)


def to_index(manifest: DataFrame, documents: DataFrame, version: str = "v3_hybrid", force: bool = False) -> DataFrame:
    """Documents (doc_id) to index: unknown, not indexed, or indexed by another schema."""
    known = manifest.select("doc_id", F.col("indexed").alias("_i"), F.col("index_schema_version").alias("_v"))
    wanted = F.lit(force) | ~F.coalesce("_i", F.lit(False)) | ~F.col("_v").eqNullSafe(F.lit(version))
    return documents.join(known, "doc_id", "left").where(wanted).select(*documents.columns)


def updated_manifest(manifest: DataFrame, done: DataFrame, order: str = "extracted_at") -> DataFrame:
    """The manifest with the rows of ``done`` in place of those of the same doc_id; of several, the last by ``order``. Columns that ``done`` lacks are null in its rows."""
    last = done.groupBy("doc_id").agg(F.max_by(F.struct(*done.columns), F.struct(F.col(order), F.xxhash64(*done.columns))).alias("r")).select("r.*")
    return manifest.join(last.select("doc_id"), "doc_id", "left_anti").unionByName(last, allowMissingColumns=True)


def years_of(rows: DataFrame, keys: list[str], year: str = "fiscal_year") -> DataFrame:
    """Of each key, its fiscal years, latest first, and the latest; years are numbers, or text that is cast to them, and what is none is left out."""
    number = F.col(year).cast("string").try_cast("int")
    years = F.sort_array(F.collect_set(number), asc=False)
    return rows.groupBy(*keys).agg(years.alias("years"), F.max(number).alias("latest"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"), F.round(F.sum("extraction_cost_usd"), 4).alias("cost_usd"))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("doc_type").agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.round(F.sum("extraction_cost_usd"), 4).alias("cost_usd"))
