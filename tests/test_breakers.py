from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerlens.streaming import breakers
from ledgerlens.streaming.breakers import State, run, through, ways

SECOND = 1_000_000


def calls(rng, n, gaps=(0, 1, 5, 12, 29, 30, 31, 100), share=0.7):
    now, times = 0, []
    for _ in range(n):
        now += rng.choice(gaps) * SECOND
        times.append(now)
    return times, [rng.random() < share for _ in range(n)]


def test_a_blocks_function_is_what_running_it_gives():
    rng = random.Random(7)
    for _ in range(400):
        times, failed = calls(rng, rng.randrange(1, 14), share=rng.choice([0.3, 0.7, 0.95]))
        told = ways(times, failed)
        for failures in range(6):
            assert through(State(failures), *told)[0] == run(State(failures), times, failed)[1][0]
            got, want = through(State(failures), *told), run(State(failures), times, failed)[1]
            assert max(got.until, times[-1]) == max(want.until, times[-1])
        for failures in (3, 4, 7):
            for late in (0, 1, 5, 12, 29, 30):
                state = State(failures, times[0] + late * SECOND)
                got, want = through(state, *told), run(state, times, failed)[1]
                assert got.failures == want.failures and max(got.until, times[-1]) == max(want.until, times[-1])


def test_blocks_in_a_row_equal_one_run():
    rng = random.Random(8)
    for _ in range(200):
        times, failed = calls(rng, rng.randrange(1, 60))
        state, at = State(), 0
        while at < len(times):
            size = rng.randrange(1, 9)
            part = times[at : at + size], failed[at : at + size]
            want = run(state, *part)[1]
            got = through(state, *ways(*part))
            assert got.failures == want.failures and max(got.until, part[0][-1]) == max(want.until, part[0][-1])
            state, at = got, at + size
        assert state.failures == run(State(), times, failed)[1].failures


@pytest.mark.parametrize("most", [1, 3, 4_096])
def test_table_equals_plain_fold(spark, most):
    rng, rows, want = random.Random(9), [], set()
    for user in [1, 2, 3, None]:
        times, failed = calls(rng, 60 if user != 2 else 400)
        start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
        rows += [(user, 1_000 * (user or 9) + i, start + dt.timedelta(microseconds=t), f, "x") for i, (t, f) in enumerate(zip(times, failed, strict=True))]
        want |= {(user, 1_000 * (user or 9) + i, *r) for i, r in enumerate(run(State(), times, failed)[0])}
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, failed boolean, block string").repartition(5)
    got = [tuple(r) for r in breakers.breaker_states(df, most).collect()]
    assert set(got) == want and len(got) == len(want) and any(r[2] for r in got)
    assert breakers.breaker_states(df.limit(0)).count() == 0


def test_a_hot_user_is_dealt_to_several_tasks(spark):
    """One user with all the calls: its blocks lie in several parts."""
    df = spark.range(20_000).selectExpr("1L AS user_id", "id AS event_id", "timestamp_seconds(id * 7) AS ts", "id % 5 < 3 AS failed")
    got = breakers.breaker_states(df, 500)
    times, failed = [7 * SECOND * i for i in range(20_000)], [i % 5 < 3 for i in range(20_000)]
    assert {r.event_id: (r.rejected, r.failures) for r in got.collect()} == dict(enumerate(run(State(), times, failed)[0]))
