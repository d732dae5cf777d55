"""Consolidation, table changes, the manifest and chunking, over stand-ins of extracted pages.

Customers stand for companies and files, orders for yearly metrics, lineitems for pages of their order, conversations for pages with and without text; documents are chunked themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import chunking, load
from ledgerlens.plans import ingest
from ledgerlens.session import scratch, table
from ledgerlens.sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("consolidate_last_non_null", "SELECT o_custkey AS document_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS revenue, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2")
def consolidate_last_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.year("o_orderdate").alias("fiscal_year"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("revenue"), F.col("o_orderpriority").alias("priority"))
    return load.last_known(rows, ["document_id", "fiscal_year"], "o_orderkey", ["revenue", "priority"])


@query("consolidate_first_wins", "SELECT l_partkey AS segment, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, arg_min(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS revenue, min(l_orderkey) AS source_page FROM lineitem GROUP BY 1, 2")
def consolidate_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("segment"), F.year("l_shipdate").alias("fiscal_year"), F.col("l_quantity").alias("revenue"), F.col("l_orderkey").alias("source_page"), "l_linenumber")
    return load.first_of(rows, ["segment", "fiscal_year"], ["source_page", "l_linenumber", "revenue"], ["revenue", "source_page"])


@query("consolidate_distinct_struct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def consolidate_distinct_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").dropDuplicates()


@query("consolidate_reference", "SELECT conv_id AS document_id, md5(max(text) FILTER (turn = 1)) AS headline, max(role) FILTER (turn = 1) AS source, count(text) AS claims, md5(string_agg(text, '|' ORDER BY turn)) AS claimed, array_to_string(list_sort(list(DISTINCT role)), ',') AS entities FROM conversations GROUP BY 1")
def consolidate_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("headline"), F.lit(None).cast("string").alias("publication_date"), F.col("role").alias("source"),
        F.array(F.struct(F.col("text").alias("claim"), F.array().cast("array<string>").alias("entities"))).alias("key_claims"), F.array("role").alias("entities_mentioned"),
    )
    rows = load.reference_documents(pages)
    return rows.select("document_id", F.md5("headline").alias("headline"), "source", F.size("key_claims").cast("bigint").alias("claims"), F.md5(F.array_join(F.transform("key_claims", lambda c: c["claim"]), "|")).alias("claimed"), F.array_join("entities_mentioned", ",").alias("entities"))


@query(
    "load_validation_warnings",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Not a 10-K document' ELSE array_to_string(list_filter([CASE WHEN c_acctbal > 0 THEN NULL ELSE 'Missing revenue for year 2024' END, CASE WHEN n > 0 THEN NULL ELSE 'No segment revenue' END, CASE WHEN big > 0 THEN NULL ELSE 'No geographic revenue' END, CASE WHEN n > 12 THEN NULL ELSE 'No risk factors' END], lambda x: x IS NOT NULL), '; ') END AS warnings FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS big FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
)
def load_validation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("big"))
    c = table(spark, sf_dir, "customer")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    metrics = F.array(F.struct(F.lit(2024).alias("fiscal_year"), F.greatest("c_acctbal", F.lit(0.0)).alias("revenue"), F.lit(1.0).alias("net_income")))
    found = load.load_warnings(metrics, F.col("n"), F.col("big"), F.when(F.col("n") > 12, F.col("n")), F.col("c_mktsegment") != "BUILDING")
    return rows.select("c_custkey", F.array_join(found, "; ").alias("warnings"))


_LATEST = "SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"


@query("upsert_metrics", f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o FULL JOIN (SELECT l.k, CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END AS v FROM ({_LATEST}) l JOIN orders ON o_orderkey = l.seq) n ON n.k = o.k")
def upsert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    new = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).alias("v"), F.col("o_orderkey").alias("seq"))
    return load.upsert(old, new, ["k"], "seq")


@query("upsert_companies", "SELECT c_name AS ticker, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN c_name ELSE 'Name ' || c_name END AS name, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'old' ELSE 'new' END AS sector FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')")
def upsert_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Name "), "c_name")
    old = c.where("c_mktsegment IN ('AUTOMOBILE', 'BUILDING')").select(F.upper("c_name").alias("ticker"), name.alias("name"), F.lit("old").alias("sector"), "c_name")
    new = c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_name").alias("ticker"), F.when(F.col("c_acctbal") >= 0, name).alias("name"), F.lit("new").alias("sector"), "c_name")
    rows = load.upsert_companies(old, new)
    return rows.select(F.col("c_name").alias("ticker"), F.when(F.col("name") == F.upper("c_name"), F.col("c_name")).otherwise(F.col("name")).alias("name"), "sector")


@query("replace_partition", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    new = old.where("l_returnflag = 'R'").withColumn("l_quantity", F.lit(0.0))
    return load.replaced(old, new, "l_orderkey").drop("l_returnflag")


@query("cascade_delete", "SELECT 'companies' AS name, c_custkey AS id FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'metrics', o_orderkey FROM orders WHERE o_custkey <> 7")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("ticker"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    ticker = c.where("id = 7").first().ticker
    left = load.cascade_delete(c, {"metrics": o}, ticker.lower())
    return left["companies"].select(F.lit("companies").alias("name"), "id").union(left["metrics"].select(F.lit("metrics"), "id"))


_KNOWN = "c_mktsegment <> 'BUILDING'"


@query("manifest_pending", f"SELECT c_custkey AS doc_id FROM customer WHERE NOT ({_KNOWN}) OR c_acctbal < 0")
def manifest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    manifest = c.where(_KNOWN).select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_acctbal") >= 0, F.md5("c_name")).otherwise("stale").alias("file_hash"))
    return load.to_process(manifest, c.select(F.col("c_custkey").alias("doc_id"), F.md5("c_name").alias("file_hash")), if_changed=True).select("doc_id")


@query("index_pending", f"SELECT c_custkey AS doc_id FROM customer WHERE NOT ({_KNOWN}) OR c_acctbal < 0 OR c_mktsegment = 'MACHINERY'")
def index_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    manifest = c.where(_KNOWN).select(F.col("c_custkey").alias("doc_id"), (F.col("c_acctbal") >= 0).alias("indexed"), F.when(F.col("c_mktsegment") == "MACHINERY", "v1").otherwise("v3_hybrid").alias("index_schema_version"))
    return load.to_index(manifest, c.select(F.col("c_custkey").alias("doc_id")))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_type"), F.col("n_chars").alias("page_count"), F.length("text").cast("bigint").alias("chunk_count"), (F.col("n_chars") * 0.04).alias("extraction_cost_usd"))


@query("manifest_totals", "SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS pages, CAST(sum(length(text)) AS BIGINT) AS chunks, round(sum(n_chars * CAST(0.04 AS DOUBLE)), 4) AS cost_usd FROM documents")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.manifest_totals(_manifest(spark, sf_dir))


@query("manifest_summary", "SELECT lang AS doc_type, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS pages, round(sum(n_chars * CAST(0.04 AS DOUBLE)), 4) AS cost_usd FROM documents GROUP BY 1")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.manifest_summary(_manifest(spark, sf_dir))


@query(
    "constraint_violations",
    "SELECT 'companies.ticker unique' AS rule, (SELECT count(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) > 1)) AS rows UNION ALL SELECT 'financial_metrics unique by year', (SELECT count(*) FROM (SELECT o_custkey, year(o_orderdate) FROM orders GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT t || '.company_id refers', 0 FROM (VALUES ('financial_metrics'), ('segment_revenue'), ('geographic_revenue')) v(t) UNION ALL SELECT 'risk_factors.company_id refers', (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'risk_factors.severity', (SELECT count(*) FROM supplier WHERE s_acctbal < 0)",
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"))
    risks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company_id"), F.when(F.col("s_acctbal") < 0, "huge").otherwise("low").alias("severity"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("ticker"))
    return load.violations({"companies": companies, "financial_metrics": o, "segment_revenue": o, "geographic_revenue": o, "risk_factors": risks})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as pages of a document; purchases and sign-ups name a section, views an empty one."""
    kind = F.col("event_type")
    section = F.when(kind.isin("purchase", "signup"), F.concat(F.lit("Item "), kind)).when(kind == "view", "")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("page_number"), section.alias("section"), F.col("value").cast("bigint").alias("token_count"))


_NAMED = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Item ' || event_type END"


@query("section_carry_forward", f"SELECT user_id AS document_id, event_id AS page_number, last_value({_NAMED} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("document_id", "page_number", chunking.carried_section().alias("section"))


@query("section_boundary_groups", f"SELECT document_id, page_number, CAST(sum(c) OVER (PARTITION BY document_id ORDER BY page_number) AS BIGINT) AS section_group FROM (SELECT user_id AS document_id, event_id AS page_number, CASE WHEN row_number() OVER w > 1 AND {_NAMED} IS DISTINCT FROM lag({_NAMED}) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def section_boundary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).withColumn("section", F.nullif("section", F.lit("")))
    return chunking.section_groups(pages).select("document_id", "page_number", "section_group")


@query(
    "child_page_estimate",
    "SELECT user_id AS parent_id, event_id AS child_index, 1 + CAST(floor(coalesce(sum(q) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(1, sum(q) OVER (PARTITION BY user_id)) * (user_id % 5)) AS INTEGER) AS start_page FROM (SELECT *, CAST(trunc(value) AS BIGINT) AS q FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def child_page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select(F.col("document_id").alias("parent_id"), F.col("page_number").alias("child_index"), "token_count")
    totals = rows.groupBy("parent_id").agg(F.sum("token_count").alias("parent_tokens"))
    rows = rows.join(totals, "parent_id").withColumns({"parent_start": F.lit(1), "parent_end": (F.lit(1) + F.col("parent_id") % 5).cast("int")})
    return chunking.child_pages(rows).select("parent_id", "child_index", "start_page")


@query(
    "fiscal_years",
    "SELECT o_custkey, coalesce(array_to_string(list_sort(list(DISTINCT TRY_CAST(y AS INTEGER)) FILTER (TRY_CAST(y AS INTEGER) IS NOT NULL), 'DESC'), ','), '') AS years, max(TRY_CAST(y AS INTEGER)) AS latest FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y FROM orders) GROUP BY 1",
)
def fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", said.alias("fiscal_year"))
    return load.years_of(rows, ["o_custkey"]).select("o_custkey", F.array_join("years", ",").alias("years"), "latest")


@query(
    "manifest_update",
    "WITH m AS (SELECT s_name AS doc_id, CAST(s_suppkey % 40 AS INTEGER) AS page_count, abs(s_acctbal) AS cost FROM supplier WHERE s_suppkey % 3 > 0),"
    " d AS (SELECT s_name AS doc_id, CAST(7 AS INTEGER) AS page_count, CAST(s_suppkey % 9 AS DOUBLE) AS cost FROM supplier WHERE s_suppkey % 2 = 0)"
    " SELECT doc_id, page_count, cost FROM d UNION ALL SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM d)",
)
def manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the suppliers are in the manifest; half of all are extracted anew, some of them twice."""
    s = table(spark, sf_dir, "supplier")
    known = s.where("s_suppkey % 3 > 0").select(F.col("s_name").alias("doc_id"), (F.col("s_suppkey") % 40).cast("int").alias("page_count"), F.abs("s_acctbal").alias("cost"), F.lit(0).alias("extracted_at"))
    done = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("doc_id"), F.lit(7).alias("page_count"), (F.col("s_suppkey") % 9).cast("double").alias("cost"), F.lit(2).alias("extracted_at"))
    early = done.where("page_count = 7").withColumns({"page_count": F.lit(1), "extracted_at": F.lit(1)})
    return load.updated_manifest(known, done.unionByName(early)).select("doc_id", "page_count", "cost")


@query(
    "table_commits",
    "SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 'changed' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 100 <> 9"
    " UNION ALL SELECT -1 - c_custkey, 'new', CAST(1 AS DOUBLE) FROM customer WHERE c_custkey % 100 = 7",
)
def table_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of all customers, of which one in a hundred is changed, one deleted, and one comes; each change is a commit that reads and writes the buckets of its keys."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    stored = tables.Table.create(c, scratch(spark, "customers"), ["c_custkey"], buckets=32)
    some = c.where("c_custkey % 100 = 7")
    changed = some.withColumns({"segment": F.lit("changed"), "balance": F.lit(None).cast("double")})
    stored.upsert(changed.unionByName(some.withColumns({"c_custkey": -1 - F.col("c_custkey"), "segment": F.lit("new"), "balance": F.lit(1.0)})))
    stored.delete(c.where("c_custkey % 100 = 9").select("c_custkey"))
    return stored.read()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extracted documents: their lines as pages, with a metric, two segments and two risks each."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    segment = lambda n: F.struct(F.concat(F.lit(f"S{n}-"), "l_returnflag").alias("segment_name"), (F.col("l_linenumber") % 2 + 2020).alias("fiscal_year"), (F.col("l_quantity") * n).alias("revenue"))
    risk = lambda n: F.struct(F.concat(F.lit(f"R{n}-"), "l_linestatus").alias("title"), F.col("l_linenumber").alias("note"))
    page = F.struct(F.col("l_linenumber").alias("page_number"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_shipmode") if "l_shipmode" in li.columns else F.col("l_returnflag")).alias("text"), F.array(segment(1), segment(2)).alias("segment_data"), F.array(risk(1), risk(2)).alias("risk_factors"))
    pages = li.select(F.col("l_orderkey").alias("o_orderkey"), page.alias("p")).groupBy("o_orderkey").agg(F.collect_list("p").alias("pages"))
    return pages.join(o, "o_orderkey").withColumn("document_id", F.col("o_orderkey"))


@query("page_explode", "SELECT l_orderkey AS document_id, l_linenumber AS page_number FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber % 3 > 0")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with text of documents whose pages are arrays."""
    return load.with_text(load.page_rows(_documents(spark, sf_dir))).select("document_id", "page_number")


_ITEMS = "SELECT l_orderkey AS document_id, 'S' || n || '-' || l_returnflag AS segment_name, l_linenumber % 2 + 2020 AS fiscal_year, l_quantity * n AS revenue, l_linenumber AS source_page, n FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES (1), (2)) t(n)"


@query("segment_unnest", f"SELECT document_id, segment_name, fiscal_year, source_page FROM (SELECT *, row_number() OVER (PARTITION BY document_id, segment_name, fiscal_year ORDER BY source_page, n) AS r FROM ({_ITEMS})) WHERE r = 1")
def segment_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment and year of a document once, as on its first page."""
    return load.distinct_items(load.page_rows(_documents(spark, sf_dir)), "segment_data", "segment_name").select("document_id", "segment_name", "fiscal_year", "source_page")


@query("risk_unnest", "SELECT document_id, title, min(source_page) AS source_page FROM (SELECT l_orderkey AS document_id, 'R' || n || '-' || l_linestatus AS title, l_linenumber AS source_page FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES (1), (2)) t(n)) GROUP BY 1, 2")
def risk_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.distinct_items(load.page_rows(_documents(spark, sf_dir)), "risk_factors", "title", year=False).select("document_id", "title", "source_page")


@query("items_by_revenue", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS revenue FROM supplier ORDER BY coalesce(CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END, 0) DESC, s_suppkey LIMIT 30")
def items_by_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 7 > 0, F.col("s_acctbal")).alias("revenue"))
    return load.by_revenue(rows, "s_suppkey").limit(30)


@query(
    "document_metadata",
    "SELECT upper(lang) || '_10K_' || (2000 + doc_id % 25) || '_' || doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE '10k' END AS document_type, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' END, ''), upper(lang)) AS ticker,"
    " CASE WHEN doc_id % 5 = 0 THEN 1999 ELSE CAST(2000 + doc_id % 25 AS INTEGER) END AS fiscal_year, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'document' END AS source_type, source AS source_name FROM documents WHERE lang IS NOT NULL",
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata out of nested values, the ticker and the year out of the id where they are missing."""
    d = F.col("doc_id")
    none = F.lit(None).cast("string")
    meta = F.struct(
        none.alias("company"), F.when(d % 2 == 0, "").alias("ticker"), F.when(d % 5 == 0, 1999).alias("fiscal_year"), F.when(d % 4 == 0, F.col("source")).alias("source_type"), F.col("source"),
        none.alias("publication_date"), none.alias("headline"),
    )
    name = F.concat(F.upper("lang"), F.lit("_10K_"), (2000 + d % 25).cast("string"), F.lit("_"), d.cast("string"))
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(name.alias("document_id"), F.when(d % 3 == 0, "news").otherwise("sec_10K").alias("document_type"), meta.alias("metadata"), F.lit(1).alias("total_pages"))
    return ingest.document_metadata(rows).select("document_id", "document_type", "ticker", "fiscal_year", "source_type", "source_name")


_HEAD = "CASE WHEN doc_id % 3 = 0 THEN '[10-K Filing] [' || coalesce(source, 'Unknown Company') || ' (N/A)] [FY' || (2000 + doc_id % 25) || '] [' || coalesce(lang, 'Unknown Section') || '] [Page ' || doc_id % 9 || ' of ?]' ELSE '[document] [' || coalesce(source, 'Unknown Source') || '] [Unknown Date]' END || chr(10) || chr(10)"


@query("chunk_enrichment")
def chunk_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document's context before them, tokens counted anew."""
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("document_id", F.col("doc_id"))
    children = d.select("document_id", F.substring("text", 1, 500).alias("text"), F.col("lang").alias("section"), (F.col("doc_id") % 9).alias("start_page"))
    names = {"company": F.col("source"), "ticker": none, "fiscal_year": (2000 + F.col("doc_id") % 25).cast("int"), "total_pages": none, "source_type": none, "source_name": F.col("source"), "publication_date": none, "headline": none}
    metadata = d.select("document_id", F.when(F.col("doc_id") % 3 == 0, "10k").otherwise("reference").alias("document_type"), *(c.alias(n) for n, c in names.items()))
    return chunking.enriched(children, metadata).select(F.col("document_id").alias("doc_id"), F.md5("text").alias("text"), F.md5("text_raw").alias("text_raw"), "token_count")


@query("text_page_filter", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\S')")
def text_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.with_text(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _count(text: str) -> str:
    return f"CAST(greatest(1, floor(len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) * CAST(1.3 AS DOUBLE))) AS INTEGER)"


def _short(s: str) -> str:
    """The parts of a sentence of over 200 tokens: behind its clauses, kind by kind, at last 154 words each."""
    words = "list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')"
    out = f"[{s}]"
    for mark in chunking.CLAUSES:
        out = f"flatten(list_transform({out}, lambda p: CASE WHEN {_count('p')} > 200 THEN string_split(replace(p, '{mark}', '{mark}' || chr(2)), chr(2)) ELSE [p] END))"
    out = f"flatten(list_transform({out}, lambda p: CASE WHEN {_count('p')} > 200 THEN list_transform(range(0, len({words}), 154), lambda b: array_to_string({words}[b + 1:b + 154], ' ')) ELSE [p] END))"
    return f"list_filter(list_transform({out}, lambda p: trim(p, {_BLANKS})), lambda p: p <> '')"


def _packed(name: str, given: str, most: int, overlap: int = 50) -> str:
    """Tables of texts (key, text) cut into sentences and packed: ``{name}`` (key, i, text), by a recursion over the sentences.

    The tables have no text of over 100,000 characters.
    """
    return f"""
    {name}_p AS (SELECT key, i, CASE WHEN {_count('s')} > 200 THEN {_short('s')} ELSE [s] END AS parts
        FROM (SELECT key, i, trim(s, {_BLANKS}) AS s FROM (SELECT key, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT key, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM {given}))) WHERE s <> ''),
    {name}_s AS (SELECT key, s, row_number() OVER (PARTITION BY key ORDER BY i, k) AS j FROM (SELECT key, i, unnest(parts) AS s, unnest(range(len(parts))) AS k FROM {name}_p)),
    {name}_t AS (SELECT key, j, s, {_count('s')} AS t, CAST(sum({_count('s')}) OVER (PARTITION BY key ORDER BY j) AS BIGINT) AS c FROM {name}_s),
    {name}_o AS (SELECT *, c - t AS before FROM {name}_t),
    {name}_r AS (
        SELECT key, CAST(1 AS BIGINT) AS j, CAST(1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS cb, CAST(0 AS BIGINT) AS ce FROM {name}_t WHERE j = 1
        UNION ALL
        SELECT r.key, n.j, CASE WHEN n.c - l.before > {most} THEN greatest(r.b, (SELECT coalesce(min(q.j), n.j) FROM {name}_t q WHERE q.key = r.key AND q.j < n.j AND q.j >= n.j - {overlap + 1} AND n.before - (q.c - q.t) <= {overlap})) ELSE r.b END,
            CASE WHEN n.c - l.before > {most} THEN r.b ELSE 0 END, CASE WHEN n.c - l.before > {most} THEN n.j - 1 ELSE 0 END
        FROM {name}_r r JOIN {name}_o n ON n.key = r.key AND n.j = r.j + 1 JOIN {name}_o l ON l.key = r.key AND l.j = r.b
    ),
    {name}_e AS (SELECT key, max(j) AS m FROM {name}_t GROUP BY key),
    {name}_b AS (SELECT key, cb AS b, ce AS e, false AS last FROM {name}_r WHERE ce > 0 UNION ALL SELECT r.key, r.b, r.j, true FROM {name}_r r JOIN {name}_e e ON e.key = r.key AND e.m = r.j),
    {name}_c AS (SELECT b.key, b.b, b.last, (SELECT string_agg(t.s, ' ' ORDER BY t.j) FROM {name}_t t WHERE t.key = b.key AND t.j BETWEEN b.b AND b.e) AS text FROM {name}_b b),
    {name} AS (SELECT key, text, row_number() OVER (PARTITION BY key ORDER BY last, b) - 1 AS i FROM (SELECT *, last AND text = lag(text) OVER (PARTITION BY key ORDER BY last, b) AS twin FROM {name}_c) WHERE NOT coalesce(twin, false))"""


_DOCS = "docs AS (SELECT doc_id AS key, text, source FROM documents WHERE regexp_matches(text, '\\S'))"
_PARENTS = f"{_DOCS}, {_packed('parent', 'docs', 1024)}, parents AS (SELECT doc_id, key, i, parent.text, {_count('parent.text')} AS tokens, source FROM parent JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = key)"
_CHILDREN = f"{_PARENTS}, named AS (SELECT doc_id || '_parent_' || i AS key, text FROM parents), {_packed('child', 'named', 256)}"


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one page, its source the section."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("source").alias("section"), "text")
    return chunking.chunk_documents(pages)


@query("chunk_semantic", f"WITH RECURSIVE {_PARENTS} SELECT doc_id || '_parent_' || i AS parent_id, CAST(doc_id AS VARCHAR) AS document_id, text, tokens AS token_count, 1 AS start_page, 1 AS end_page, source AS section, CAST(i AS INTEGER) AS parent_index FROM parents")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parents(spark, sf_dir)


@query(
    "chunk_parent_child",
    f"WITH RECURSIVE {_CHILDREN} SELECT c.key || '_child_' || c.i AS child_id, c.key AS parent_id, CAST(p.doc_id AS VARCHAR) AS document_id, c.text, {_count('c.text')} AS token_count, 1 AS start_page, 1 AS end_page, p.source AS section,"
    " CAST(c.i AS INTEGER) AS child_index, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i, c.i) - 1 AS INTEGER) AS child_index_in_document FROM child c JOIN parents p ON p.doc_id || '_parent_' || p.i = c.key",
)
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.children_of(_parents(spark, sf_dir))


@query(
    "chunk_stats",
    f"WITH RECURSIVE {_CHILDREN}, n AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS parents FROM parents GROUP BY doc_id), m AS (SELECT split_part(key, '_', 1) AS document_id, count(*) AS children, CAST(floor(sum({_count('text')}) / count(*)) AS BIGINT) AS mean_tokens FROM child GROUP BY 1)"
    " SELECT document_id, parents, children, round(children / parents, 1) AS children_per_parent, mean_tokens FROM n JOIN m USING (document_id)",
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _parents(spark, sf_dir)
    return chunking.chunk_stats(parents, chunking.children_of(parents))


ORACLES["chunk_enrichment"] = f"SELECT doc_id, md5({_HEAD} || substr(text, 1, 500)) AS text, md5(substr(text, 1, 500)) AS text_raw, {_count(f'({_HEAD} || substr(text, 1, 500))')} AS token_count FROM documents WHERE text IS NOT NULL"
