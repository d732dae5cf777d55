from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import guard
from ledgerlens.plans.ask import arguments_of, ask, clean_sql, run_tools
from ledgerlens.schema import TABLES
from ledgerlens.session import register

PASS = [
    "SELECT * FROM companies",
    "WITH x AS (SELECT * FROM companies) SELECT * FROM x",
    "SELECT name FROM companies WHERE name = 'DROP TABLE users'",
    "SELECT EXTRACT(YEAR FROM filing_date), TRIM(BOTH 'x' FROM name) FROM companies",
    "SELECT * FROM companies c JOIN LATERAL (SELECT * FROM risk_factors r WHERE r.company_id = c.id) t",
    "(SELECT id FROM companies) UNION (SELECT company_id FROM segment_revenue)",
    "SELECT 1",
    "SELECT * FROM companies WHERE EXISTS (SELECT 1 FROM risk_factors) AND id > (SELECT max(id) FROM segment_revenue)",
    "WITH a AS (SELECT * FROM companies), b AS (SELECT * FROM a) SELECT * FROM b UNION ALL SELECT * FROM a",
    "VALUES (1)",
    "SELECT ticker, sum(revenue) FILTER (WHERE fiscal_year > 2020), rank() OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM companies GROUP BY CUBE(ticker) HAVING count(*) > 1 ORDER BY 1 LIMIT 5 OFFSET 2",
    "SELECT CASE WHEN a LIKE 'x%' OR b NOT ILIKE ANY ('y', 'z') THEN a::int ELSE try_cast(b AS int) END, transform(c, x -> x + 1)[0], d.e || 'f', date '2024-01-01' + interval 1 day FROM companies",
    "SELECT e FROM companies LATERAL VIEW explode(split(name, ' ')) t AS e WHERE id BETWEEN 1 AND 2 AND name IS DISTINCT FROM 'x'",
    "SELECT sum(a) OVER w FROM companies WINDOW w AS (PARTITION BY b)",
    "SELECT * FROM companies PIVOT (sum(a) FOR b IN (1, 2))",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY revenue) FROM companies",
]
FAIL = {
    "DELETE FROM companies": guard.NOT_READ_ONLY,
    "SELECT * FROM companies, users": "users",
    "SELECT * FROM `users`": "users",
    "SELECT * FROM companies WHERE id IN (SELECT id FROM secrets)": "secrets",
    "SELECT * FROM companies; DROP TABLE companies": "",
    "WITH x AS (SELECT * FROM hidden) SELECT * FROM x": "hidden",
    "SELECT (SELECT max(k) FROM other) FROM companies": "other",
    "CREATE TABLE t AS SELECT * FROM companies": guard.NOT_READ_ONLY,
    "SELECT * FROM companies WHERE EXISTS (SELECT 1 FROM hidden)": "hidden",
    "SELECT CASE WHEN id IN (SELECT k FROM hidden) THEN 1 END FROM companies": "hidden",
    "SELECT * FROM companies ORDER BY (SELECT max(k) FROM hidden)": "hidden",
    "SELECT * FROM companies c JOIN LATERAL (SELECT * FROM hidden h WHERE h.k = c.id) t": "hidden",
    "WITH x AS (SELECT * FROM y), y AS (SELECT * FROM companies) SELECT * FROM x": "y",
    "INSERT INTO companies SELECT * FROM companies": guard.NOT_READ_ONLY,
    "SELECT TRANSFORM(id) USING 'echo ran' AS (a) FROM companies": guard.NOT_READ_ONLY,
    "SELECT * FROM (SELECT TRANSFORM(id) USING 'cat' FROM companies)": guard.NOT_READ_ONLY,
    "SELECT 1 WHERE EXISTS (SELECT TRANSFORM(id) USING 'cat' FROM companies)": guard.NOT_READ_ONLY,
    "SELECT * FROM identifier('users')": guard.NOT_READ_ONLY,
    "SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.name')": "Not allowed",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.name') FROM companies": "java_method",
    "SELECT reflect('java.util.UUID', 'randomUUID') FROM companies": "reflect",
    "SELECT try_reflect('java.util.UUID', 'randomUUID') FROM companies": "try_reflect",
    "SELECT max(reflect('java.util.UUID', 'randomUUID')) OVER () FROM companies": "reflect",
    "SELECT id FROM companies ORDER BY java_method('java.util.UUID', 'randomUUID')": "java_method",
    "SELECT input_file_name() FROM companies": "input_file_name",
    "SELECT input_file_block_start() FROM companies": "input_file_block_start",
    "SELECT _metadata.file_path FROM companies": "_metadata",
    "SELECT current_user FROM companies": "current_user",
    "SELECT current_user() FROM companies": "current_user",
    "SELECT `session_user` FROM companies": "session_user",
    "SELECT builtin.abs(1) FROM companies": "builtin.abs",
    "SELECT * FROM range(10)": guard.NOT_READ_ONLY,
    "SELECT * FROM companies c, LATERAL explode(array(1))": guard.NOT_READ_ONLY,
    "SELECT * FROM companies LATERAL VIEW java_method('a', 'b') t": "java_method",
    "SELECT * FROM db.companies": "db.companies",
    "SELECT * FROM spark_catalog.default.companies": "spark_catalog.default.companies",
    "SELECT * FROM parquet.`/etc`": "parquet./etc",
    "SELECT * FROM `db.companies`": "db.companies",
    "WITH companies AS (SELECT * FROM x.companies) SELECT * FROM companies": "x.companies",
    "FROM companies |> WHERE id > 1": guard.NOT_READ_ONLY,
    "EXECUTE IMMEDIATE 'SELECT 1'": guard.NOT_READ_ONLY,
    "BEGIN SELECT 1; END": guard.NOT_READ_ONLY,
    "SELECT * FROM companies FOR VERSION AS OF 1": guard.NOT_READ_ONLY,
    "SELECT :a FROM companies": "Not allowed",
    "SHOW TABLES": guard.NOT_READ_ONLY,
    "SET a = 1": guard.NOT_READ_ONLY,
    "": "Empty",
    "   ": "Empty",
}


@pytest.mark.parametrize("sql", PASS)
def test_parser_accepts(spark, sql):
    assert guard.validate(sql, spark) is None


@pytest.mark.parametrize("sql", FAIL)
def test_parser_rejects(spark, sql):
    why = guard.validate(sql, spark)
    assert why is not None and FAIL[sql] in why


@pytest.mark.parametrize("sql", [s for s in FAIL if "TRANSFORM" in s or "method" in s or "reflect" in s or "identifier" in s])
def test_nothing_of_a_rejected_statement_runs(spark, sql):
    with pytest.raises(guard.Rejected):
        guard.run(spark, sql)


def test_lexical_rules():
    assert guard.validate("SELECT * FROM users") == "Access denied: tables not allowed: users"
    assert guard.named_tables("SELECT 'FROM x' FROM public.Companies -- FROM y") == {"companies"}
    # The lexical judgement takes these for what they aren't; the parser doesn't.
    assert guard.validate("SELECT EXTRACT(YEAR FROM filing_date) FROM companies") is not None
    assert guard.validate("SELECT * FROM companies, users") is None
    assert not guard.is_read_only("SELECT 'please INSERT coin'")
    assert guard.sanitised("SELECT 1 /* x\ny */ ;") == "SELECT 1 LIMIT 100"
    assert guard.limited("SELECT * FROM (SELECT 1 LIMIT 5000) LIMIT 2") == "SELECT * FROM (SELECT 1 LIMIT 1000) LIMIT 1000"


def test_tokens_give_the_statement_again():
    sql = "SELECT 'it''s -- no comment', \"a /* b\" FROM x -- y\n WHERE z = 12.5 /* open"
    assert "".join(t.text for t in guard.tokens(sql)) == sql
    assert [t.text for t in guard.tokens(sql) if t.kind in ("literal", "quoted", "comment")] == ["'it''s -- no comment'", '"a /* b"', "-- y", "/* open"]
    assert guard.normalised("SELECT  'a  b'\n\t, 1 --x\n FROM/**/t ") == "SELECT 'a  b' , 1 FROM t"
    assert guard.named_tables("SELECT 1 FROM/**/users JOIN a.b.c ON 1 = 1") == {"users", "b"}
    assert guard.named_tables("SELECT 'FROM x' FROM \"y\" WHERE a IN (SELECT 1 FROM (SELECT 2 FROM z))") == {"z"}


def test_columns():
    assert guard.unknown_columns("companies", ["id", "Ticker"]) is None
    assert "password" in guard.unknown_columns("companies", ["password"])
    assert guard.unknown_columns("users", ["id"]) == "Table not allowed: users"
    assert "revenue" in guard.table_columns("financial_metrics") and guard.table_columns("users") == []


@pytest.fixture
def tables(spark):
    companies = spark.createDataFrame([(1, "AAA", "Alpha", None, None, None, None, None, None), (2, "BBB", "Beta", None, None, None, None, None, None)], TABLES["companies"])
    from decimal import Decimal

    row = lambda i, c, y, rev: (i, c, y, rev, *[None] * 15, "USD", None)
    metrics = spark.createDataFrame([row(1, 1, 2024, Decimal("1500.00")), row(2, 2, 2024, None), row(3, 2, 2023, Decimal("900.00"))], TABLES["financial_metrics"])
    register(spark, {"companies": companies, "financial_metrics": metrics})
    return spark


def test_bounds_are_on_the_plan(tables):
    tables.range(3000).createOrReplaceTempView("segment_revenue")
    assert guard.run(tables, "SELECT * FROM segment_revenue").count() == 100
    assert guard.run(tables, "SELECT * FROM segment_revenue LIMIT 2500;").count() == 1000
    assert guard.run(tables, "SELECT * FROM (SELECT * FROM segment_revenue LIMIT 2000)").count() == 100
    assert guard.run(tables, "SELECT * FROM segment_revenue ORDER BY id LIMIT 5 OFFSET 2").first().id == 2
    with pytest.raises(guard.Rejected):
        guard.run(tables, "SELECT nothing FROM segment_revenue")


def test_question_to_answer(tables):
    said = ask(tables, "Which company had the highest revenue in 2024?")
    assert "ticker: AAA" in said and "revenue: $1,500M" in said and "Statement: SELECT" in said
    with pytest.raises(ValueError):
        ask(tables, "  ")
    assert guard.formatted([], "q") == "No rows match.\nStatement: q"
    many = guard.formatted([{"ticker": "A", "revenue": 5, "x": 1}] * 12, "q")
    assert many.startswith("12 rows, of which the first 10:\n1. ticker: A, revenue: $5M\n") and "10. ticker" in many and "11." not in many


def test_slow_queries_are_cancelled(spark):
    df = spark.range(10**13).selectExpr("sum(id % 7) AS s")
    with pytest.raises(guard.Rejected, match="timed out"):
        guard.collect(df, 1.0)


def test_tools_go_on_after_errors():
    rows = run_tools({"add": lambda a, b: a + b}, [{"name": "add", "args": {"a": 1, "b": 2}}, {"name": "add", "args": '{"a": 1}'}, {"name": "no"}, {"name": "add", "args": "{"}])
    assert [r["status"] for r in rows] == ["ok", "error", "error", "error"] and rows[0]["content"] == "3"
    assert arguments_of({"name": "x", "arguments": "{}"}) == ("x", {})
    assert clean_sql("```sql\nSELECT 1\n```") == "SELECT 1"


#: Statements, the lexical verdict on them, their tables, and what is left of them.
VERDICTS = [
    ("SELECT * FROM companies", None, "companies", "SELECT * FROM companies LIMIT 100"),
    ("SELECT * FROM companies LIMIT 50", None, "companies", "SELECT * FROM companies LIMIT 50"),
    ("SELECT * FROM companies LIMIT 5000;", None, "companies", "SELECT * FROM companies LIMIT 1000;"),
    ("SELECT * FROM companies -- all", None, "companies", "SELECT * FROM companies LIMIT 100"),
    ("DELETE FROM companies", "Only SELECT queries are allowed", "companies", "DELETE FROM companies LIMIT 100"),
    ("SELECT * INTO temp FROM companies", "Only SELECT queries are allowed", "companies,temp", "SELECT * INTO temp FROM companies LIMIT 100"),
    ("SELECT * FROM users", "Access denied: tables not allowed: users", "users", "SELECT * FROM users LIMIT 100"),
    ("SELECT c.name FROM public.companies c JOIN financial_metrics f ON c.id = f.company_id", None, "companies,financial_metrics", "SELECT c.name FROM public.companies c JOIN financial_metrics f ON c.id = f.company_id LIMIT 100"),
    ("SELECT 1", None, "", "SELECT 1 LIMIT 100"),
]


def test_verdicts(spark):
    log = spark.createDataFrame([(s,) for s, *_ in VERDICTS] + [(None,)], "statement string")
    assert sorted(map(tuple, guard.judged(log).collect()), key=str) == sorted([*VERDICTS, (None,) * 4], key=str)


def test_shown_columns_equal_shown_values(spark):
    rows = [(1234567.5, 45.25, 2.675, 2024), (-0.5, 0.05, 1e7, 1999), (1.5, 45.35, 0.125, 2000)]
    df = spark.createDataFrame(rows, "revenue double, gross_margin double, diluted_eps double, fiscal_year int")
    got = guard.shown_columns(df, df.columns).collect()
    assert [tuple(r) for r in got] == [tuple(guard.shown(c, v) for c, v in zip(df.columns, r, strict=True)) for r in rows]


def test_statements_are_cut_once_and_as_before(monkeypatch):
    """Odd statements of ASCII are cut as others are, and judging one cuts it once, and again only for a limit."""
    rng = random.Random(1)
    bits = ["'", '"', "--", "/*", "*/", "-", "/", "*", "\n", " ", "\x0b", "\x1c", "a", "SELECT", "from", "LIMIT", "12", "9999", "_x", ".", "public.", ";", "companies", "''", "INTO ", "1x", "\x00"]
    for _ in range(3000):
        sql = "".join(rng.choices(bits, k=rng.randrange(0, 14)))
        assert list(guard.tokens(sql)) == list(guard._tokens(sql)) and "".join(t.text for t in guard.tokens(sql)) == sql
        assert guard._told(sql) == (guard.validate(sql), ",".join(sorted(guard.named_tables(sql))), guard.sanitised(sql))
    asked, cut = [], guard.tokens
    monkeypatch.setattr(guard, "tokens", lambda sql: asked.append(sql) or cut(sql))
    assert guard._told("SELECT a FROM companies WHERE b = 'x'") == (None, "companies", "SELECT a FROM companies WHERE b = 'x' LIMIT 100")
    assert asked == ["SELECT a FROM companies WHERE b = 'x'", "x"]


def test_statements_of_one_split_are_judged_by_several_tasks(spark):
    log = spark.range(2000, numPartitions=1).selectExpr("concat('SELECT ', id, ' FROM companies') AS statement")
    rows = guard.judged(log).select("sanitised", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) == 4 and {r.sanitised for r in rows} == {f"SELECT {i} FROM companies LIMIT 100" for i in range(2000)}
