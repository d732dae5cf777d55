"""Guarded SQL, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import guard
from ledgerlens.session import register, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _guarded(name: str, sql: str, tables: list[str], oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, {t: table(spark, sf_dir, t) for t in tables})
        return guard.run(spark, sql, tables)

    query(name, oracle or sql)(run)


_guarded("guarded_top_metric", "SELECT s.s_suppkey, s.s_name, n.n_name, s.s_acctbal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey ORDER BY s.s_acctbal DESC NULLS LAST, s.s_suppkey LIMIT 10", ["supplier", "nation"])
_guarded("guarded_lookup_by_key", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7", ["customer"])
_guarded("guarded_default_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", ["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_guarded("guarded_limit_cap", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5000", ["orders"], "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
_guarded("guarded_offset", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5", ["part"])
_guarded("guarded_subquery", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_custkey, b.n FROM customer c JOIN big b ON b.o_custkey = c.c_custkey WHERE c.c_acctbal > (SELECT avg(c_acctbal) FROM customer) ORDER BY b.n DESC, c.c_custkey LIMIT 50", ["orders", "customer"], "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c.c_custkey, b.n FROM customer c JOIN big b ON b.o_custkey = c.c_custkey WHERE c.c_acctbal > (SELECT avg(c_acctbal) FROM customer) ORDER BY b.n DESC, c.c_custkey LIMIT 50")

def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: Statements of each event, by its number; what the lexical guard says of them; their tables; and what is left of them.
_SAID = [
    ("concat('SELECT * FROM companies WHERE id = ', event_id)", "NULL", "'companies'", "given || ' LIMIT 100'"),
    ("concat('SELECT * FROM companies LIMIT ', event_id % 2000 + 1)", "NULL", "'companies'", "CASE WHEN event_id % 2000 + 1 > 1000 THEN 'SELECT * FROM companies LIMIT 1000' ELSE given END"),
    ("concat('SELECT  a --', user_id, chr(10), 'FROM public.companies;')", "NULL", "'companies'", "'SELECT a FROM public.companies LIMIT 100'"),
    ("concat('DELETE FROM companies WHERE id = ', user_id)", "'Only SELECT queries are allowed'", "'companies'", "given || ' LIMIT 100'"),
    ("concat('SELECT * INTO ', event_type, ' FROM companies')", "'Only SELECT queries are allowed'", "CASE WHEN event_type < 'companies' THEN event_type || ',companies' ELSE 'companies,' || event_type END", "given || ' LIMIT 100'"),
    ("concat('SELECT * FROM ', event_type, user_id)", "'Access denied: tables not allowed: ' || event_type || CAST(user_id AS VARCHAR)", "event_type || CAST(user_id AS VARCHAR)", "given || ' LIMIT 100'"),
    ("concat('SELECT ', event_id, ' LIMIT ', user_id)", "NULL", "''", "CASE WHEN user_id > 1000 THEN 'SELECT ' || CAST(event_id AS VARCHAR) || ' LIMIT 1000' ELSE given END"),
]


def _by_number(column: int) -> str:
    return f"CASE event_id % {len(_SAID)} " + " ".join(f"WHEN {i} THEN {r[column]}" for i, r in enumerate(_SAID)) + " END"


_JUDGED = f"SELECT event_id, {_by_number(1)} AS verdict, {_by_number(2)} AS tables, {_by_number(3)} AS sanitised FROM (SELECT *, {_by_number(0)} AS given FROM events)"


@query("guard_decisions", _JUDGED)
def guard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of statements, one of each event, judged in tasks."""
    log = table(spark, sf_dir, "events").select("event_id", F.expr(_by_number(0)).alias("statement"))
    return guard.judged(log).select("event_id", "verdict", "tables", "sanitised")


@query(
    "metric_by_year_join",
    "SELECT n.n_name, CAST(year(o.o_orderdate) AS INTEGER) AS fiscal_year, round(sum(o.o_totalprice), 2) AS revenue, count(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2",
)
def metric_by_year_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name", F.year("o_orderdate").alias("fiscal_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment_name"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))


_SEGMENTS = "SELECT c_mktsegment AS segment_name, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query("segment_revenue_share", f"WITH s AS ({_SEGMENTS}) SELECT segment_name, fiscal_year, CAST(revenue AS DOUBLE) AS revenue, round(100 * CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY fiscal_year) AS DOUBLE), 4) AS percentage_of_total FROM s")
def segment_revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("revenue").over(Window.partitionBy("fiscal_year")).cast("double")
    revenue = F.col("revenue").cast("double")
    return _segments(spark, sf_dir).select("segment_name", "fiscal_year", revenue.alias("revenue"), F.round(F.lit(100) * revenue / total, 4).alias("percentage_of_total"))


@query("segment_yoy_growth", f"WITH s AS ({_SEGMENTS}), p AS (SELECT *, lag(revenue) OVER (PARTITION BY segment_name ORDER BY fiscal_year) AS before FROM s) SELECT segment_name, fiscal_year, round(100 * (CAST(revenue AS DOUBLE) / CAST(before AS DOUBLE) - 1), 4) AS yoy_growth FROM p")
def segment_yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("revenue").over(Window.partitionBy("segment_name").orderBy("fiscal_year")).cast("double")
    return _segments(spark, sf_dir).select("segment_name", "fiscal_year", F.round(100 * (F.col("revenue").cast("double") / before - 1), 4).alias("yoy_growth"))


@query(
    "geo_revenue_rollup",
    "SELECT r_name AS region, n_name AS nation, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS revenue, CAST(grouping(r_name, n_name) AS BIGINT) AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def geo_revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return out.agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"), F.grouping_id().alias("level"))


@query("risk_category_counts", "SELECT o_orderpriority AS category, o_orderstatus AS severity, count(*) AS risks, count(DISTINCT o_custkey) AS companies FROM orders GROUP BY 1, 2 HAVING count(*) > 5")
def risk_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("severity"))
    return rows.agg(F.count("*").alias("risks"), F.countDistinct("o_custkey").alias("companies")).where("risks > 5")


@query("grouping_sets_cube", "SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


@query("grouping_sets_sql", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, {"orders": table(spark, sf_dir, "orders")})
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("join_semi_anti", "SELECT 'with' AS kind, c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    each = lambda kind, how: c.join(o, c.c_custkey == o.o_custkey, how).select(F.lit(kind).alias("kind"), "c_custkey")
    return each("with", "left_semi").union(each("without", "left_anti"))


@query("join_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(sums, c.c_custkey == sums.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("spent", F.lit(0.0)).alias("spent"))


@query("join_full_outer", "SELECT coalesce(s.k, c.k) AS nation, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.k = c.k")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full").select("nation", "suppliers", "customers")


@query("join_theta", "SELECT r.r_name, count(*) AS pairs FROM region r JOIN nation n ON n.n_nationkey > r.r_regionkey AND n.n_regionkey <> r.r_regionkey GROUP BY 1")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.join(n, (n.n_nationkey > r.r_regionkey) & (n.n_regionkey != r.r_regionkey)).groupBy("r_name").agg(F.count("*").alias("pairs"))


@query("join_lateral", "SELECT n.n_name, t.c_custkey, t.c_acctbal FROM nation n, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    best = c.withColumn("_n", rank).where("_n <= 2")
    return best.join(n, best.c_nationkey == n.n_nationkey).select("n_name", "c_custkey", "c_acctbal")


@query("set_union_intersect_except", "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def set_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).union(named("intersect", c.intersect(s))).union(named("except", n.exceptAll(s.distinct())))


@query("subquery_correlated", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def subquery_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    mean = o.groupBy("o_custkey").agg((F.lit(1.5) * F.avg("o_totalprice")).alias("_m"))
    return o.join(mean, "o_custkey").where("o_totalprice > _m").select("o_orderkey", "o_custkey", "o_totalprice")


@query("rank_within_group", "SELECT s_nationkey, s_suppkey, rank() OVER w AS rank, dense_rank() OVER w AS dense FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal, -2) DESC)")
def rank_within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.round("s_acctbal", -2).desc())
    return table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"))


@query("running_total", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double").alias("running"))


@query("topk_per_group", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return table(spark, sf_dir, "part").withColumn("_n", rank).where("_n <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("null_order_last", "SELECT * FROM (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best FROM orders GROUP BY 1) ORDER BY best DESC NULLS LAST, o_custkey LIMIT 30")
def null_order_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("best"))
    return best.orderBy(F.col("best").desc_nulls_last(), "o_custkey").limit(30)


@query("integer_division", "SELECT o_orderkey, o_custkey // 7 AS whole, o_custkey / 7 AS exact FROM orders")
def integer_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey div 7").alias("whole"), (F.col("o_custkey") / 7).alias("exact"))
