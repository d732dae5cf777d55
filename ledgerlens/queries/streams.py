"""Limits, breakers and conversation events over the events and conversations tables, as batches.

The same operators run on streams; ``tests/test_streaming.py`` holds the two forms together. Session windows are an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import providers
from ledgerlens.session import table
from ledgerlens.streaming import conversations, events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("rate_limit_window", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests, least(count(*), 60) AS allowed FROM events GROUP BY 1, 2")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.allowed_by_minute(table(spark, sf_dir, "events"), "user_id")


@query("daily_quota", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 240 AS allowed FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.within_quota(table(spark, sf_dir, "events")).select("event_id", F.col("day").cast("string").alias("day"), "allowed")


@query(
    "circuit_breaker_state",
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),"
    " r AS (SELECT user_id, event_id, n, false AS rejected, CASE WHEN failed THEN 1 ELSE 0 END AS failures, CAST(0 AS DOUBLE) AS until FROM o WHERE n = 1"
    " UNION ALL SELECT o.user_id, o.event_id, o.n, o.t < r.until, CASE WHEN o.t < r.until THEN r.failures WHEN o.failed THEN r.failures + 1 ELSE 0 END,"
    " CASE WHEN o.t < r.until THEN r.until WHEN o.failed AND r.failures + 1 >= 3 THEN o.t + 30 ELSE r.until END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)"
    " SELECT user_id, event_id, rejected, failures FROM r",
)
def circuit_breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return events.breaker_states(calls)


_LAST = "SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations"


@query("incremental_messages", f"SELECT conv_id, turn FROM ({_LAST}) WHERE last IS NULL OR turn > last")
def incremental_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.new_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("message_events", "SELECT conv_id, turn, 'message' AS type, md5(text) AS content FROM conversations WHERE role = 'assistant' AND trim(text) <> '' UNION ALL SELECT conv_id, turn, 'thinking', md5(CAST(turn AS VARCHAR)) FROM conversations WHERE role = 'assistant'")
def message_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("<thinking> "), F.col("turn").cast("string"), F.lit("</thinking>"), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(events.message_events(F.col("role"), said)).alias("e"))
    return rows.select("conv_id", "turn", "e.type", F.md5("e.content").alias("content"))


@query("message_sanitize", "SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) < 400 THEN '(calling tools)' ELSE md5(text) END AS content FROM conversations WHERE NOT (role = 'assistant' AND length(text) < 400 AND turn < 2)")
def message_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("role") == "assistant") & (F.length("text") < 400), " ").otherwise(F.md5("text")).alias("content"), F.when(F.col("turn") >= 2, 1).alias("tool_calls"))
    return events.sanitised_messages(rows).select("conv_id", "turn", "content")


#: A user's events as a conversation, ten minutes as a second: two kinds are put into the queue, the others read; up to two may wait.
_PUTS = "('click', 'view')"
_STREAM = f"""
    WITH RECURSIVE o AS (
        SELECT user_id AS c, event_id AS seq, CAST(floor(epoch(ts) / 600) AS BIGINT) AS sec, event_type IN {_PUTS} AS put,
            row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts) / 600) AS BIGINT), event_id) AS n FROM events
    ), r AS (
        SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS waiting, false AS opened, CAST(-1 AS BIGINT) AS due,
            CAST([] AS STRUCT(sec BIGINT, seq BIGINT, type VARCHAR)[]) AS gives FROM o
        UNION ALL
        SELECT c, n, CASE WHEN ends THEN [] WHEN gave THEN held[2:] ELSE held END, NOT ends AND (opened OR NOT put),
            CASE WHEN gave THEN -1 WHEN NOT put AND late < 0 THEN sec + 15 ELSE late END,
            list_concat(list_transform(quiet, lambda x: {{'sec': x, 'seq': NULL, 'type': 'keep-alive'}}),
                CASE WHEN refused THEN [{{'sec': sec, 'seq': seq, 'type': 'refused'}}] ELSE [] END,
                CASE WHEN NOT put AND NOT opened THEN [{{'sec': sec, 'seq': NULL, 'type': 'open'}}] ELSE [] END,
                CASE WHEN gave THEN [{{'sec': sec, 'seq': held[1], 'type': CASE WHEN ends THEN 'complete' ELSE 'message' END}}] ELSE [] END)
        FROM (
            SELECT *, gave AND held[1] % 20 = 0 AS ends FROM (
                SELECT *, (NOT put OR (NOT refused AND late >= 0)) AND len(held) > 0 AS gave FROM (
                    SELECT *, CASE WHEN put AND NOT refused THEN list_append(waiting, seq) ELSE waiting END AS held, CASE WHEN due >= 0 THEN due + 15 * len(quiet) ELSE -1 END AS late FROM (
                        SELECT o.*, r.waiting, r.opened, r.due, o.put AND len(r.waiting) > 2 AS refused, CASE WHEN r.due >= 0 THEN range(r.due, o.sec, 15) ELSE [] END AS quiet
                        FROM r JOIN o ON o.c = r.c AND o.n = r.n + 1))))
    ), told AS (SELECT c, unnest(gives, recursive := true) FROM r)
    SELECT c AS conv_id, sec AS second, seq, CASE WHEN type = 'keep-alive' THEN ': keep-alive' ELSE 'data: {{"type":"' || type || '"' || CASE WHEN type = 'open' THEN '' ELSE ',"content":"' || e.event_type || '"' END || ',"conversationId":"' || c || '"}}' END || chr(10) || chr(10) AS frame
    FROM told LEFT JOIN events e ON e.event_id = seq
"""


@query("conversation_stream", _STREAM)
def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = F.col("event_type").isin("click", "view")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000)).alias("ts"),
        F.when(put, "put").otherwise("read").alias("action"), F.when(F.col("event_id") % 20 == 0, "complete").otherwise("message").alias("type"), F.col("event_type").alias("content"),
    )
    told = conversations.frames(conversations.delivered(rows, 2))
    return told.select("conv_id", F.unix_seconds("at").alias("second"), "seq", "frame")


@query("agent_state", "SELECT conv_id AS conversation_id, count(text) AS messages, array_to_string(list_distinct(list(role ORDER BY turn)), ',') AS roles FROM conversations GROUP BY 1")
def agent_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), F.col("text").alias("message"), F.col("role").alias("tool"), F.lit(None).cast("string").alias("error"))
    return events.folded_state(changes).select("conversation_id", F.size("messages").cast("bigint").alias("messages"), F.array_join(F.array_sort("tools_used"), ",").alias("roles"))


ORACLES["agent_state"] = ORACLES["agent_state"].replace("list_distinct(list(role ORDER BY turn))", "list_sort(list(DISTINCT role))")


@query("health_rollup", "SELECT CASE WHEN bool_or(event_type = 'error') THEN 'degraded' ELSE 'ok' END AS status FROM events")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.health(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query("session_windows", "SELECT user_id, min(ts) AS start, count(*) AS events, round(sum(value), 2) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w"))
    return rows.agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")


@query("tool_argument_parse", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def tool_argument_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", events.tool_arguments(F.col("props"), "k long")["k"].cast("double").alias("k"))


@query("quotes_default", "SELECT upper(event_type) AS ticker, CAST(123.45 AS DOUBLE) AS price, 'mock' AS source FROM (SELECT DISTINCT event_type FROM events)")
def quotes_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("")).alias("symbol"))
    return providers.quotes_of(asked, "symbol").select("ticker", "price", "source")


@query("quotes_parsed", "SELECT upper(event_type) AS ticker, value AS price, value / 100 AS change_percent, strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, 'live' AS source FROM events")
def quotes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        F.upper("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(0.1).alias("change"), (F.col("value") / 100).alias("changePercentage"), F.col("user_id").alias("volume"), (1700000000 + F.col("event_id")).alias("timestamp"),
    )
    return providers.parsed_quotes(raw).select("ticker", "price", "change_percent", "timestamp", "source")


@query("web_results_default", "SELECT item_id, 'Result ' || i || ' for item ' || item_id AS title, 'https://example.com/' || i AS url FROM benchmark, range(1, 4) t(i)")
def web_results_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("question"))
    return providers.web_results_of(asked, "question", 10).select("item_id", "title", "url")
