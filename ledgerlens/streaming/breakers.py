"""Circuit breakers over long histories, as a segmented scan.

What a call meets depends on all calls of its user before it. So that no task has to take a whole history, it is cut into blocks of
consecutive calls, by ranges of (user, time, id), and a block is summed up as a function: from the state in which it is entered to the state in which it is left. States
are the failures counted (0, 1, 2, or more) and the time until which the circuit is open. From a closed circuit there are four cases. An
open one turns calls away until its time, which is at most ``OPEN_SECONDS`` after the block's first call, and then goes on like a closed one with three
failures or more; so there is one case for each call of that time. All cases come from one pass over the block from its end. The
functions of a user's blocks are applied in order, which takes a few numbers for each block; then every block is run forward from the state it is entered in.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import scratch
from ledgerlens.streaming.events import BREAKER, FAILURES, OPEN_SECONDS

#: Calls of a block.
CALLS = 4_096
_OPEN = OPEN_SECONDS * 1_000_000
_CLOSED = -(1 << 62)


class State(NamedTuple):
    """Failures counted, and until when the circuit is open (microseconds)."""

    failures: int = 0
    until: int = _CLOSED


class Way(NamedTuple):
    """How a block is left: failures, to be added to those it was entered with if ``more``; until when the circuit is open, None if that is as it was."""

    failures: int
    more: bool
    until: int | None

    def leave(self, state: State) -> State:
        return State(self.failures + state.failures * self.more, state.until if self.until is None else self.until)


def ways(times: list[int], failed: list[bool]) -> tuple[list[Way], list[int], list[Way]]:
    """The four ways from a closed circuit, by failures counted, the last standing for ``FAILURES`` and more; and for an open one the times of the calls that may be the first let in, with the way from each.

    From the block's end: the ways from each call on are those of a later one, after what the call itself does.
    """
    n = len(times)
    stay = [Way(0, True, None)] * (FAILURES + 1)
    after: list[list[Way]] = [stay] * (n + 1)
    for i in range(n - 1, -1, -1):
        mine = []
        for f in range(FAILURES + 1):
            if not failed[i]:
                way = after[i + 1][0]
                # A success: no failures are counted, so what is added is nothing.
                mine.append(Way(way.failures, False, _CLOSED if way.until is None else way.until))
                continue
            now = f + 1
            if now < FAILURES:
                way = after[i + 1][now]
                mine.append(Way(way.failures + way.more, way.more, way.until))
                continue
            until = times[i] + _OPEN
            way = after[bisect_left(times, until, i + 1)][FAILURES]
            mine.append(Way(way.failures + way.more, way.more, until if way.until is None else way.until))
        after[i] = mine
    late = bisect_left(times, times[0] + _OPEN) if n else 0
    return after[0], times[: late + 1], [after[i][FAILURES] for i in range(min(late + 1, n))]


def through(state: State, closed: list[Way], times: list[int], opened: list[Way]) -> State:
    """The state after a block that is entered in a state."""
    if not times or state.until <= times[0]:
        return closed[min(state.failures, FAILURES)].leave(state)
    k = bisect_left(times, state.until)
    return opened[k].leave(state) if k < len(opened) else state


def run(state: State, times: list[int], failed: list[bool]) -> tuple[list[tuple[bool, int]], State]:
    """(turned away, failures counted after it) of each call, and the state after the last."""
    failures, until = state
    out = []
    for t, f in zip(times, failed, strict=True):
        away = t < until
        if not away:
            failures = failures + 1 if f else 0
            if failures >= FAILURES:
                until = t + _OPEN
        out.append((away, failures))
    return out, State(failures, until)


_AT = "user_id bigint, part int, block int"
_BLOCK = f"{_AT}, ids array<bigint>, times array<bigint>, failed array<boolean>"
_WAY = "array<struct<failures: bigint, more: boolean, until: bigint>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def breaker_states(calls: DataFrame, most: int = CALLS) -> DataFrame:
    """(user_id, event_id, rejected, failures) for each call (user_id, event_id, ts, failed) of a table, by user in order of (ts, event_id); null times come first, nulls in ``failed`` are no failures."""
    spark = calls.sparkSession
    micros = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0))
    rows = calls.select(F.col("user_id").cast("bigint").alias("user_id"), micros.alias("t"), F.col("event_id").cast("bigint").alias("event_id"), F.coalesce("failed", F.lit(False)).alias("failed"))
    ordered = rows.repartitionByRange("user_id", "t", "event_id").sortWithinPartitions("user_id", "t", "event_id")
    block, way = _arrow(_BLOCK), _arrow(f"{_AT}, closed {_WAY}, times array<bigint>, opened {_WAY}")
    state, told = _arrow(f"{_AT}, failures bigint, until bigint"), _arrow(BREAKER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        now: object = None
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, number
            times, ids, failed = map(list, zip(*held, strict=True))
            out.append((now, part, number, ids, times, failed))
            held, number = [], number + 1

        for batch in batches:
            for user, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (user != now or len(held) >= most):
                    close()
                    if len(out) >= 256:
                        yield _batch(out, block)
                        out.clear()
                now = user
                held.append(tuple(row))
        if held:
            close()
        if out:
            yield _batch(out, block)

    path = scratch(spark, "breaker-blocks")
    ordered.mapInArrow(cut, _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                out = []
                for user, part, number, times, failed in given:
                    closed, early, opened = ways(times, failed)
                    out.append((user, part, number, [w._asdict() for w in closed], early, [w._asdict() for w in opened]))
                yield _batch(out, way)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), State()
        for batch in batches:
            out = []
            for user, part, number, closed, times, opened in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if user != now:
                    now, at = user, State()
                out.append((user, part, number, *at))
                at = through(at, [Way(**w) for w in closed], times, [Way(**w) for w in opened])
            if out:
                yield _batch(out, state)

    summed = blocks.select("user_id", "part", "block", "times", "failed").mapInArrow(sum_up, f"{_AT}, closed {_WAY}, times array<bigint>, opened {_WAY}")
    entered = summed.repartition("user_id").sortWithinPartitions("user_id", "part", "block").mapInArrow(enter, f"{_AT}, failures bigint, until bigint")
    # A block's number is its own within its part, so that users may be null.
    both = blocks.join(entered.select("part", "block", "failures", "until"), ["part", "block"]).select("user_id", "ids", "times", "failed", "failures", "until")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for user, ids, times, failed, failures, until in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, _ = run(State(failures, until), times, failed)
                yield _batch([(user, e, *f) for e, f in zip(ids, found, strict=True)], told)

    return both.mapInArrow(forward, BREAKER)
