"""Conversations as bounded queues, and agent state by thread, kept in Spark's state store.

A conversation's queue takes what is put into it and gives it to its reader in order. ``Queue`` says what one row does; it runs on a stream, with
the waiting items as list state and timers for idle readers, and on a table, as a fold over sorted rows that holds one queue at a time. Both give the same rows.

What is delivered goes to a sink as server-sent frames. A batch is written under its own number and becomes visible by a
mark that is written last, so a batch that is replayed after a failure writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Items that may wait before more are refused, seconds of silence after which a reader hears a sign of life, and what ends a conversation.
WAITING_MOST, KEEP_ALIVE_SECONDS = 100, 15
LAST = ("complete", "error")
#: The state store that processors with lists and timers need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

DELIVERED = "conv_id bigint, at timestamp, seq bigint, type string, content string"
_COLUMNS = ["conv_id", "at", "seq", "type", "content"]
_GIVEN = ["conv_id", "seq", "ts", "action", "type", "content"]


@dataclass
class Queue:
    """A conversation: times in microseconds, items as (seq, type, content)."""

    most: int = WAITING_MOST
    pause: int = KEEP_ALIVE_SECONDS * 1_000_000
    waiting: list[tuple[int, str, str | None]] = field(default_factory=list)
    opened: bool = False
    #: The last row's number and time, and when a reader that waits is to hear something; none waits at -1.
    seen: int = -1
    now: int = 0
    due: int = -1

    def idle(self, until: int) -> Iterator[tuple]:
        """Signs of life for a waiting reader, before a time."""
        while 0 <= self.due < until:
            yield self.due, None, "keep-alive", None
            self.due += self.pause

    def step(self, at: int, seq: int, action: str, kind: str | None, content: str | None) -> Iterator[tuple]:
        """What a row gives, as (at, seq, type, content): a ``put`` enters the queue or is refused, a ``read`` asks for the next item. Rows seen before give nothing; rows out of time count as of now."""
        if seq <= self.seen:
            return
        self.seen, self.now = seq, max(self.now, at)
        yield from self.idle(self.now)
        if action == "put":
            if len(self.waiting) > self.most:
                yield self.now, seq, "refused", content
            else:
                self.waiting.append((seq, kind or "message", content))
                if self.due >= 0:
                    yield from self._deliver()
        elif action == "read":
            if not self.opened:
                self.opened = True
                yield self.now, None, "open", None
            if self.waiting:
                yield from self._deliver()
            elif self.due < 0:
                self.due = self.now + self.pause

    def _deliver(self) -> Iterator[tuple]:
        seq, kind, content = self.waiting.pop(0)
        self.due = -1
        yield self.now, seq, kind, content
        if kind in LAST:  # what still waits goes, and the next reader opens it anew
            self.waiting, self.opened = [], False


def _frame(conv: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(conv, *r) for r in rows], columns=_COLUMNS)
    return out.astype({"seq": "Int64"}).assign(at=pd.to_datetime(out["at"], unit="us"))


class _Conversation(StatefulProcessor):
    """``Queue`` over the state store: the items as list state, the rest as one value; an event-time timer while a reader waits."""

    def __init__(self, most: int, pause: int):
        self.most, self.pause = most, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("waiting", "seq bigint, type string, content string")
        self.head = handle.getValueState("head", "opened boolean, seen bigint, now bigint, due bigint")

    def _read(self) -> Queue:
        held = self.head.get()
        opened, seen, now, due = held if held is not None else (False, -1, 0, -1)
        return Queue(self.most, self.pause, [tuple(i) for i in self.items.get()], opened, seen, now, due)

    def _write(self, q: Queue, before: Queue) -> None:
        if q.waiting:
            self.items.put(q.waiting)
        else:
            self.items.clear()
        self.head.update((q.opened, q.seen, q.now, q.due))
        if before.due != q.due:
            if before.due >= 0:
                self.handle.deleteTimer(before.due // 1000)
            if q.due >= 0:
                self.handle.registerTimer(q.due // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        q, before = self._read(), self._read()
        out: list[tuple] = []
        given = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for seq, ts, action, kind, content in given[_GIVEN[1:]].itertuples(index=False):
            text = lambda v: None if v is None or v != v else v
            out += q.step(ts.value // 1000, int(seq), action, text(kind), text(content))
        self._write(q, before)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        q, before = self._read(), self._read()
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = list(q.idle(timerValues.getCurrentWatermarkInMs() * 1000)) if q.due >= 0 and due * 1000 <= q.due else []
        before.due = -1  # this timer is gone
        self._write(q, before)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def delivered(actions: DataFrame, most: int = WAITING_MOST, pause: int = KEEP_ALIVE_SECONDS) -> DataFrame:
    """(conv_id, at, seq, type, content) of actions (conv_id, seq, ts, action, type, content), on a stream (after ``withWatermark`` on ts) or a table.

    Rows of a conversation are taken in order of (ts, seq); on a stream, those of a batch. Each ``put`` is delivered once, to a ``read``, first in, first out, or
    is refused where more than ``most`` wait. ``open`` comes first. A reader that waits gets ``keep-alive`` after each ``pause`` seconds, on a
    table up to the conversation's last row, on a stream up to the watermark. ``complete`` and ``error`` end a conversation. Rows with a number seen before give nothing. Null ids are a conversation, null types messages.
    """
    rows = actions.select(*_GIVEN)
    micros = pause * 1_000_000
    if rows.isStreaming:
        return rows.groupBy("conv_id").transformWithStateInPandas(_Conversation(most, micros), DELIVERED, "Append", "EventTime")

    ordered = rows.select("conv_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "seq", "action", "type", "content").repartition("conv_id").sortWithinPartitions("conv_id", "ts", "seq")
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("seq", pa.int64()), ("type", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q = object(), Queue(most, micros)
        for batch in batches:
            out = []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    now, q = conv, Queue(most, micros)
                out += [(conv, *o) for o in q.step(*row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ordered.mapInArrow(run, DELIVERED)


def frames(events: DataFrame) -> DataFrame:
    """(conv_id, at, seq, frame): delivered events as server-sent frames; a sign of life is a comment."""
    told = F.to_json(F.struct("type", F.col("content"), F.col("conv_id").cast("string").alias("conversationId")), {"ignoreNullFields": "true"})
    frame = F.when(F.col("type") == "keep-alive", F.lit(": keep-alive\n\n")).otherwise(F.concat(F.lit("data: "), told, F.lit("\n\n")))
    return events.select("conv_id", "at", "seq", frame.alias("frame"))


class FrameSink:
    """A folder of batches, each under its number and marked when it is whole; give ``write`` to ``foreachBatch``."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _path(self, spark: SparkSession, path: str):
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(spark._jsc.hadoopConfiguration()), made

    def written(self, spark: SparkSession) -> list[int]:
        """Numbers of the whole batches."""
        files, at = self._path(spark, f"{self.folder}/marks")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []

    def write(self, events: DataFrame, batch: int) -> None:
        """Writes a batch, unless it is there already; what a failed attempt left of it is replaced."""
        spark = events.sparkSession
        files, mark = self._path(spark, f"{self.folder}/marks/{batch}")
        if files.exists(mark):
            return
        frames(events).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        files.create(mark, False).close()

    def read(self, spark: SparkSession) -> DataFrame:
        """The frames of the whole batches, with their batch's number."""
        schema = "conv_id bigint, at timestamp, seq bigint, frame string"
        whole = self.written(spark)
        if not whole:
            return spark.createDataFrame([], f"{schema}, batch bigint")
        rows = spark.read.schema(schema).parquet(*(f"{self.folder}/batches/{b}" for b in whole))
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batches/(\d+)/", 1).cast("bigint")
        return rows.withColumn("batch", number)


# Agent state, by thread

STATE = "messages array<string>, tools_used array<string>, last_error string, seq bigint"


class _Thread(StatefulProcessor):
    """Changes added to what the thread's state holds: messages add up, tools are a set in order of first use, an error of '' clears the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get()
        messages, tools, error, seen = (list(held[0]), list(held[1]), held[2], held[3]) if held is not None else ([], [], None, -1)
        for seq, message, tool, failed in pd.concat(list(rows)).sort_values("seq")[["seq", "message", "tool", "error"]].itertuples(index=False):
            if seq <= seen:
                continue
            seen = int(seq)
            messages += [message] if isinstance(message, str) else []
            tools += [tool] if isinstance(tool, str) and tool not in tools else []
            error = (failed or None) if isinstance(failed, str) else error
        self.state.update((messages, tools, error, seen))
        yield pd.DataFrame([(key[0], len(messages), seen)], columns=["thread_id", "messages", "seq"])

    def close(self) -> None:
        pass


def state_by_thread(changes: DataFrame) -> DataFrame:
    """Keeps the agent's state of each thread of a stream of changes (thread_id, seq, message, tool, error); gives (thread_id, messages: number, seq) as it changes. Changes seen before count once."""
    rows = changes.select("thread_id", "seq", "message", "tool", "error")
    return rows.groupBy("thread_id").transformWithStateInPandas(_Thread(), "thread_id string, messages bigint, seq bigint", "Update", "None")


def saved_state(spark: SparkSession, checkpoint: str, threads: list[str] | None = None) -> DataFrame:
    """(thread_id, messages, tools_used, last_error, seq) out of the state store under a stream's checkpoint; of some threads, if they are named."""
    rows = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
    found = rows.select(F.col("key.thread_id").alias("thread_id"), "value.messages", "value.tools_used", "value.last_error", "value.seq")
    return found if threads is None else found.where(F.col("thread_id").isin(*threads))
