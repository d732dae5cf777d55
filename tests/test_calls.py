from __future__ import annotations

import asyncio
import threading
import time

import pytest

from ledgerlens import calls
from ledgerlens.calls import Policy, answers, embedded, reranked

QUICK = Policy(in_flight=3, attempts=3, wait=0.001, timeout=5, window=50)


class Service:
    """Fails, delays, and counts how many it serves at a time."""

    def __init__(self, failures=0):
        self.failures, self.now, self.most, self.seen, self.lock = failures, 0, 0, {}, threading.Lock()

    def __call__(self, request):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[request] = self.seen.get(request, 0) + 1
            tries = self.seen[request]
        try:
            time.sleep(0.01 if int(request) % 3 else 0.03)
            if int(request) % 7 == 0 or tries <= self.failures:
                raise OSError("busy")
            return f"answer {request}"
        finally:
            with self.lock:
                self.now -= 1


def test_order_limit_and_retries():
    s = Service(failures=1)
    told = calls._all(s, [str(i) for i in range(40)], QUICK)
    assert [a for a, *_ in told] == [None if i % 7 == 0 else f"answer {i}" for i in range(40)]
    assert {n for a, n, _ in told if a} == {2} and all(n == 3 and "busy" in e for a, n, e in told if a is None)
    assert 1 < s.most <= 3 and max(s.seen.values()) == 3


def test_coroutines_and_timeouts():
    async def slow(request):
        await asyncio.sleep(5 if request == "slow" else 0)
        return request.upper()

    began = time.time()
    told = calls._all(slow, ["a", "slow", "b"], Policy(attempts=1, timeout=0.1))
    assert [a for a, *_ in told] == ["A", None, "B"] and "Timeout" in told[1][2] and time.time() - began < 3
    with pytest.raises(ValueError):
        Policy(in_flight=0)


def test_each_request_once(spark, tmp_path):
    folder = str(tmp_path)

    def call(request):
        with open(f"{folder}/log", "a") as f:
            f.write(f"{request}\n")
        if request == "bad":
            raise ValueError("no")
        return request * 2

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("bad",), ("k",)] * 5, "q string").repartition(4)
    known = spark.createDataFrame([("k", "known"), ("k", "known"), ("z", None)], "request string, answer string")
    got = {r.request: r for r in answers(df, "q", call, QUICK, known).collect()}
    assert {k: r.answer for k, r in got.items()} == {"a": "aa", "b": "bb", "bad": None, "k": "known"} and got["k"].tries == 0 and "no" in got["bad"].error
    log = (tmp_path / "log").read_text().split()
    assert sorted(log) == ["a", "b", "bad", "bad", "bad"]
    assert answers(df.limit(0), "q", call).count() == 0


def test_rerank_with_a_default(spark):
    rows = [("q", "one", 1), ("q", "two words", 2), ("q", "fails", 3), ("q", "nothing said", 4), ("r", "one", 5), ("q", "one", 6)]

    def model(request):
        passage = request.split("Passage: ")[1].split("\n")[0]
        if passage == "fails":
            raise OSError
        return "I can't say" if passage.startswith("nothing") else f"Score: {3 * len(passage.split())}/10"

    got = reranked(spark.createDataFrame(rows, "question string, text string, id int"), model, QUICK).collect()
    assert sorted((r.question, r["rank"], r.id, r.relevance_score) for r in got) == [("q", 1, 2, 6.0), ("q", 2, 3, 5.0), ("q", 3, 4, 5.0), ("q", 4, 1, 3.0), ("q", 5, 6, 3.0), ("r", 1, 5, 3.0)]


def test_embeddings_by_batches(spark):
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise OSError
        return [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(t,) for t in ["a", "bb", "bad", None, "a", "ccc"]], "t string")
    assert {r.text: r["values"] for r in embedded(df, "t", embed, size=2, wait=0.001).collect()} == {"a": [1.0, 1.0], "bb": [2.0, 1.0], "bad": None, "ccc": [3.0, 1.0]}
