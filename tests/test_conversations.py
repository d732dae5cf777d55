from __future__ import annotations

import datetime as dt
import json
import random
from pathlib import Path

import pytest

from ledgerlens.streaming import conversations as C

START = dt.datetime(2024, 1, 1)
ACTIONS = "conv_id long, seq long, ts timestamp, action string, type string, content string"


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in C.STATE_STORE}
    for k, v in C.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def actions(rng, convs=5, n=40):
    rows = []
    for c in range(convs):
        now = 0
        for i in range(n):
            now += rng.choice([0, 1, 3, 20, 31])
            put = rng.random() < (0.8 if i < n // 2 else 0.4)
            rows.append((c, i, at(now), "put" if put else "read", rng.choice([None, "message", "message", "complete", "tool_used"]) if put else None, f"{c}-{i}" if put else None))
    return rows


def plain(rows, most):
    """Queues by lists, reader by reader."""
    out = []
    for c in sorted({r[0] for r in rows}):
        waiting, opened, asked, heard = [], False, False, None
        for _, seq, ts, action, kind, content in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            while asked and heard + dt.timedelta(seconds=15) < ts:
                heard += dt.timedelta(seconds=15)
                out.append((c, heard, None, "keep-alive", None))
            if action == "put":
                if len(waiting) > most:
                    out.append((c, ts, seq, "refused", content))
                    continue
                waiting.append((seq, kind or "message", content))
            else:
                if not opened:
                    out.append((c, ts, None, "open", None))
                    opened = True
                if not asked:
                    asked, heard = True, ts
            if asked and waiting:
                item = waiting.pop(0)
                out.append((c, ts, *item))
                asked = False
                if item[1] in ("complete", "error"):
                    waiting, opened = [], False
    return out


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("most", [2, 100])
def test_table_equals_plain_queues(spark, most):
    rows = actions(random.Random(most))
    df = spark.createDataFrame(rows, ACTIONS).repartition(3)
    got = C.delivered(df, most).collect()
    want = plain(rows, most)
    assert keyed(got) == keyed(want)
    assert {"open", "keep-alive", "complete", "message"} <= {r.type for r in got} and (most > 2 or any(r.type == "refused" for r in got))


def test_limit_is_beyond_a_hundred(spark):
    rows = [(1, i, at(i), "put", None, str(i)) for i in range(105)] + [(1, 200 + i, at(200 + i), "read", None, None) for i in range(105)]
    got = C.delivered(spark.createDataFrame(rows, ACTIONS)).collect()
    assert [r.content for r in got if r.type == "refused"] == [str(i) for i in range(101, 105)]
    assert [r.content for r in got if r.type == "message"] == [str(i) for i in range(101)] and [r.type for r in got].count("open") == 1


def source(spark, path, schema):
    Path(path).mkdir()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, sink, checkpoint):
    q = df.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    assert q.exception() is None


def test_stream_equals_table_and_resumes(store, tmp_path):
    rows = [r for r in actions(random.Random(4), 4, 24)]
    last = max(r[2] for r in rows)
    rows += [(c, 100, last + dt.timedelta(seconds=60 + c), "put", "error", "end") for c in range(4)]
    rows += [(c, 101 + k, last + dt.timedelta(seconds=70 + c + k), "read", None, None) for c in range(4) for k in range(30)]
    rows += [(9, 0, last + dt.timedelta(days=1), "read", None, None)]  # moves the watermark
    rows.sort(key=lambda r: r[2])
    path, checkpoint, sink = str(tmp_path / "in"), str(tmp_path / "check"), C.FrameSink(str(tmp_path / "out"))
    batches = source(store, path, ACTIONS).withWatermark("ts", "0 seconds")
    half = len(rows) // 2
    store.createDataFrame(rows[:half], ACTIONS).coalesce(1).write.mode("append").parquet(path)
    run(C.delivered(batches, 2), sink, checkpoint)
    first = len(sink.written(store))
    # A replay of rows seen, beside new ones, after a restart.
    store.createDataFrame(rows[half - 10 :], ACTIONS).coalesce(1).write.mode("append").parquet(path)
    run(C.delivered(batches, 2), sink, checkpoint)
    assert len(sink.written(store)) > first > 0
    table = C.frames(C.delivered(store.createDataFrame(rows, ACTIONS), 2)).where("conv_id < 9")
    # A stream goes on giving signs of life up to the watermark.
    ends = {c: max(r[2] for r in rows if r[0] == c) for c in range(4)}
    got = [r for r in sink.read(store).drop("batch").where("conv_id < 9").collect() if r.at <= ends[r.conv_id]]
    assert keyed(got) == keyed(table.collect()) and any("refused" in r.frame for r in got) and any("keep" in r.frame for r in got)


def test_idle_reader_hears_up_to_the_watermark(store, tmp_path):
    path, checkpoint, sink = str(tmp_path / "in"), str(tmp_path / "check"), C.FrameSink(str(tmp_path / "out"))
    batches = source(store, path, ACTIONS).withWatermark("ts", "0 seconds")
    store.createDataFrame([(1, 0, at(0), "read", None, None)], ACTIONS).coalesce(1).write.mode("append").parquet(path)
    run(C.delivered(batches), sink, checkpoint)
    store.createDataFrame([(2, 0, at(50), "read", None, None)], ACTIONS).coalesce(1).write.mode("append").parquet(path)
    run(C.delivered(batches), sink, checkpoint)
    mine = sorted((r.at, r.frame) for r in sink.read(store).where("conv_id = 1").collect())
    assert [(t - START).seconds for t, f in mine if f == ": keep-alive\n\n"] == [15, 30, 45]
    assert json.loads(mine[0][1].removeprefix("data: ")) == {"type": "open", "conversationId": "1"}


def test_replayed_batches_write_nothing_twice(spark, tmp_path):
    sink = C.FrameSink(str(tmp_path / "out"))
    events = C.delivered(spark.createDataFrame([(1, 0, at(0), "put", None, "a"), (1, 1, at(1), "read", None, None)], ACTIONS))
    assert sink.read(spark).count() == 0
    C.frames(events).limit(1).write.parquet(f"{sink.folder}/batches/7")  # an attempt that failed before its mark
    assert sink.read(spark).count() == 0
    for _ in range(2):
        sink.write(events, 7)
    sink.write(events.limit(0), 8)
    assert sink.written(spark) == [7, 8] and sorted((r.batch, r.frame[:5]) for r in sink.read(spark).collect()) == [(7, "data:"), (7, "data:")]


def test_state_is_read_by_thread_and_resumed(store, tmp_path):
    schema = "thread_id string, seq long, message string, tool string, error string"
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    batches = source(store, path, schema)
    parts = [
        [("c", 1, "m1", "sql", None), ("c", 2, None, "rag", "boom"), ("d", 1, "x", None, "bad")],
        [("c", 2, None, "rag", "boom"), ("c", 3, "m2", "sql", None), ("d", 2, "y", None, "")],
    ]
    for k, part in enumerate(parts):
        store.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        q = C.state_by_thread(batches).writeStream.format("memory").queryName(f"threads{k}").outputMode("update").option("checkpointLocation", checkpoint)
        q = q.trigger(availableNow=True).start() if not k else C.state_by_thread(batches).writeStream.foreachBatch(lambda df, n: df.count()).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
        assert q.exception() is None
    got = {r.thread_id: tuple(r)[1:] for r in C.saved_state(store, checkpoint).collect()}
    assert got == {"c": (["m1", "m2"], ["sql", "rag"], "boom", 3), "d": (["x", "y"], [], None, 2)}
    assert [r.thread_id for r in C.saved_state(store, checkpoint, ["d"]).collect()] == ["d"]
