from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.streaming import events

SF = "/root/testdata/sf0.001"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(40)
    q.stop()
    assert q.exception() is None
    return df.sparkSession.table(name)


def stream(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_minute_limits_on_a_stream_equal_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = stream(spark, tmp_path, table).withWatermark("ts", "60 days")
    got = drain(events.allowed_by_minute(late, "user_id", most=1), "minute_counts", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.allowed_by_minute(table, "user_id", most=1).collect()))


def test_breaker_on_a_stream_equals_the_table(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(u, 100 * u + i, start + dt.timedelta(seconds=7 * i), (i * u) % 5 < 3) for u in range(1, 6) for i in range(40)]
    table = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean")
    path = str(tmp_path / "in")
    for k in range(4):  # batches in order of time
        table.where((F.col("event_id") % 100 >= 10 * k) & (F.col("event_id") % 100 < 10 * k + 10)).coalesce(1).write.mode("append").parquet(path)
    batches = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(events.breaker_states(batches), "breakers")
    want = events.breaker_states(table).collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and any(r.rejected for r in want)


def test_breaker_keeps_failures_when_time_is_over():
    b = events.Breaker()
    assert [b.step(t, True) for t in (0, 1, 2)] == [(False, 1), (False, 2), (False, 3)]
    assert b.step(10, False) == (True, 3) and b.step(40, True) == (False, 4) and b.step(41, False)[0]
    assert b.step(71, False) == (False, 0)


def test_quota(spark):
    start = dt.datetime(2024, 1, 1, 23, 59)
    rows = [(i, start + dt.timedelta(seconds=i % 90)) for i in range(300)]
    got = events.within_quota(spark.createDataFrame(rows, "event_id long, ts timestamp"), most=50).groupBy("day").agg(F.count_if("allowed").alias("n"), F.count("*").alias("all")).collect()
    assert sorted((str(r.day), r.n) for r in got) == [("2024-01-01", 50), ("2024-01-02", 50)]


def test_client_events(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", " "), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = drain(events.event_stream(stream(spark, tmp_path, df, 1), 3_600_000), "client").collect()
    assert sorted((r.conv_id, r.type, r.content or "") for r in got) == [(1, "message", "a"), (1, "open", ""), (2, "message", "b"), (2, "open", "")]


def test_replayed_turns_give_no_events(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    path = str(tmp_path / "in")
    make([(1, 0, "user", "q"), (1, 1, "assistant", "a")]).write.parquet(path)
    make([(1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")]).write.mode("append").parquet(path)
    batches = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(events.event_stream(batches, 3_600_000), "replays").collect()
    assert sorted((r.type, r.content or "") for r in got) == [("message", "a"), ("message", "b"), ("open", "")]


def test_messages(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "<thinking>t</thinking> x", None), (1, 2, "tool", "r", None), (1, 3, "assistant", "", 2), (1, 4, "assistant", " ", 0), (2, 0, "assistant", "only", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, tool_calls int")
    kinds = [(r.turn, r.e.type) for r in df.select("turn", "conv_id", F.explode(events.message_events(F.col("role"), F.col("content"))).alias("e")).where("conv_id = 1").collect()]
    assert kinds == [(1, "thinking"), (1, "message"), (2, "tool_used")]
    assert sorted((r.conv_id, r.turn) for r in events.new_messages(df).collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    kept = {r.turn: r.content for r in events.sanitised_messages(df).where("conv_id = 1").collect()}
    assert kept[3] == "(calling tools)" and 4 not in kept


def test_state(spark):
    rows = [("c", 1, "m1", "sql", None), ("c", 2, None, "rag", "boom"), ("c", 3, "m2", "sql", None), ("d", 1, "x", None, "bad"), ("d", 2, "y", None, "")]
    got = {r.conversation_id: r for r in events.folded_state(spark.createDataFrame(rows, "conversation_id string, seq int, message string, tool string, error string")).collect()}
    assert (got["c"].messages, got["c"].tools_used, got["c"].last_error) == (["m1", "m2"], ["sql", "rag"], "boom")
    assert got["d"].last_error is None and got["d"].tools_used == []
    assert events.health(spark.createDataFrame([("ok",), ("error",)], "status string")).first().status == "degraded"
    assert events.health(spark.createDataFrame([], "status string")).first().status == "ok"
