"""Conversation events, rate limits, quotas and circuit breakers, on streams and on tables.

Each stateful operator has two forms: one on a stream, with keyed state and timers, and one on a table, as windows, with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests a minute, calls a day, failures that open a circuit, and for how long.
PER_MINUTE, PER_DAY, FAILURES, OPEN_SECONDS = 60, 240, 3, 30


# Messages


def new_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages after the last user message of each conversation; all, if there is none."""
    last = F.max(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(conv))
    return messages.withColumn("_last", last).where(F.col("_last").isNull() | (F.col(turn) > F.col("_last"))).drop("_last")


def message_events(role: Column, content: Column, tool: Column | None = None) -> Column:
    """The events of a message, in order: an assistant's thinking and message, a tool's use; blank ones are left out."""
    marked = content.rlike("(?is)<thinking>.*?</thinking>")
    thought = F.trim(F.regexp_extract(content, "(?is)<thinking>(.*?)</thinking>", 1))
    said = F.when(marked, F.trim(F.regexp_replace(content, "(?is)<thinking>.*?</thinking>", ""))).otherwise(content)
    event = lambda kind, text, name=None: F.struct(F.lit(kind).alias("type"), text.alias("content"), (F.lit(None).cast("string") if name is None else name).alias("tool"))
    some = lambda c: c.isNotNull() & (F.trim(c) != "")
    thinking = F.when((role == "assistant") & marked & some(thought), event("thinking", thought))
    message = F.when((role == "assistant") & some(said), event("message", said))
    used = F.when(role == "tool", event("tool_used", content, F.lit("tool") if tool is None else tool))
    return F.array_compact(F.array(thinking, message, used))


def sanitised_messages(messages: DataFrame) -> DataFrame:
    """Rows (role, content, tool_calls: number); an empty assistant message goes, or says that it calls tools."""
    empty = (F.col("role") == "assistant") & (F.trim(F.coalesce("content", F.lit(""))) == "")
    calls = F.coalesce("tool_calls", F.lit(0)) > 0
    return messages.where(~empty | calls).withColumn("content", F.when(empty, "(calling tools)").otherwise(F.col("content")))


def tool_arguments(arguments: Column, schema: str) -> Column:
    """Arguments of a tool call out of JSON text; null if it can't be read."""
    return F.from_json(arguments, schema, {"mode": "PERMISSIVE"})


def event_stream(messages: DataFrame, pause_ms: int = 60_000) -> DataFrame:
    """The client's events of a stream of messages (conv_id, turn, role, text, ts): ``open`` first, ``complete`` after a pause (of a minute), in order by key. Turns up to the last one seen are replays, and give nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "type", "content"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "complete", None)], columns=columns)
            return
        rows = [] if state.exists else [(key[0], "open", None)]
        seen = state.get[0] if state.exists else -1
        for pdf in batches:
            for turn, role, text in pdf.sort_values("turn")[["turn", "role", "text"]].itertuples(index=False):
                if turn <= seen:
                    continue
                if role == "assistant" and isinstance(text, str) and text.strip():
                    rows.append((key[0], "message", text))
                seen = int(turn)
        state.update((seen,))
        state.setTimeoutDuration(pause_ms)
        yield pd.DataFrame(rows, columns=columns)

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, type string, content string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


# Limits


def allowed_by_minute(events: DataFrame, key: str, ts: str = "ts", most: int = PER_MINUTE) -> DataFrame:
    """(key, minute, requests, allowed) of fixed windows; on a stream after ``withWatermark``, which late rows have to meet."""
    counts = events.groupBy(F.window(ts, "1 minute").alias("w"), F.col(key)).agg(F.count("*").alias("requests"))
    return counts.select(key, F.col("w.start").alias("minute"), "requests", F.least("requests", F.lit(most)).alias("allowed"))


def within_quota(calls: DataFrame, ts: str = "ts", order: str = "event_id", most: int = PER_DAY) -> DataFrame:
    """Adds ``day`` and ``allowed``: the first ``most`` calls of each UTC day.

    Only the ``most`` first of a day are ranked (a window with a limit, which each task applies for itself), the
    others are told by the last of them, so that no task sorts a whole day.
    """
    dated = calls.withColumn("day", F.to_date(ts))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(ts, order))
    first = dated.select("day", ts, order).withColumn("_n", rank).where(F.col("_n") <= most)
    edge = first.groupBy("day").agg(F.max(F.struct(ts, order)).alias("_edge"))
    return dated.join(edge, "day").withColumn("allowed", F.struct(ts, order) <= F.col("_edge")).drop("_edge")


class Breaker:
    """Three failures in a row open the circuit for half a minute, a success closes it; failures stay counted when the time is over."""

    def __init__(self, failures: int = 0, open_until: float = 0.0):
        self.failures, self.open_until = failures, open_until

    def step(self, now: float, failed: bool) -> tuple[bool, int]:
        """Whether the call is turned away, and the failures counted after it. A turned-away call counts for nothing."""
        if now < self.open_until:
            return True, self.failures
        self.failures = self.failures + 1 if failed else 0
        if self.failures >= FAILURES:
            self.open_until = now + OPEN_SECONDS
        return False, self.failures


BREAKER = "user_id long, event_id long, rejected boolean, failures int"


def breaker_states(calls: DataFrame) -> DataFrame:
    """(user_id, event_id, rejected, failures) for each call (user_id, event_id, ts, failed), by user in order of time.

    On a table, histories are parted into blocks (``breakers``). On a stream this is a fold that keeps two
    numbers for each user; rows of a micro-batch are taken in order.
    """
    if not calls.isStreaming:
        from ledgerlens.streaming import breakers  # it is built upon the values here

        return breakers.breaker_states(calls)

    def run(rows: pd.DataFrame, breaker: Breaker) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        out = [(u, e, *breaker.step(t.timestamp(), bool(f))) for u, e, t, f in rows[["user_id", "event_id", "ts", "failed"]].itertuples(index=False)]
        return pd.DataFrame(out, columns=["user_id", "event_id", "rejected", "failures"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(*state.get) if state.exists else Breaker()
        yield run(pd.concat(list(batches)), breaker)
        state.update((breaker.failures, breaker.open_until))

    return calls.select("user_id", "event_id", "ts", "failed").groupBy("user_id").applyInPandasWithState(step, BREAKER, "failures int, open_until double", "append", GroupStateTimeout.NoTimeout)


# Agent state, keyed by conversation


def folded_state(changes: DataFrame) -> DataFrame:
    """(conversation_id, messages, tools_used, last_error) out of changes (conversation_id, seq, message, tool, error): messages add up, tools are a set in order of first use, the last error stays unless it was cleared by ''."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "message", "tool", "error")))
    rows = changes.groupBy("conversation_id").agg(ordered.alias("c"))
    return rows.select(
        "conversation_id",
        F.array_compact(F.transform("c", lambda x: x["message"])).alias("messages"),
        F.array_distinct(F.array_compact(F.transform("c", lambda x: x["tool"]))).alias("tools_used"),
        F.nullif(F.try_element_at(F.array_compact(F.transform("c", lambda x: x["error"])), F.lit(-1)), F.lit("")).alias("last_error"),
    )


def health(checks: DataFrame) -> DataFrame:
    """One row (status): ``degraded`` if any check has an error, else ``ok``."""
    return checks.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False)), "degraded").otherwise("ok").alias("status"))
