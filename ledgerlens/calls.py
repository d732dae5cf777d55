"""Calls of models and services from tasks: each request once, a bounded number at a time, tried again, and a default where all tries fail."""

from __future__ import annotations

import asyncio
import inspect
import random
from collections.abc import Awaitable, Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import parsed_score
from ledgerlens.providers import retried

#: What a passage's relevance counts as if the model fails, and how much of a passage it sees.
DEFAULT_SCORE, PASSAGE_CHARS = 5.0, 2_000


@dataclass(frozen=True)
class Policy:
    """How a service is called: requests in flight in a task, tries, seconds before the second try (doubled each time, with some chance in it) and for a try."""

    in_flight: int = 8
    attempts: int = 3
    wait: float = 0.1
    timeout: float = 30.0
    #: Requests that a task has at hand at a time, whose answers come in order.
    window: int = 512

    def __post_init__(self) -> None:
        if min(self.in_flight, self.attempts, self.window) < 1:
            raise ValueError("in_flight, attempts and window must be positive")


Call = Callable[[str], str | Awaitable[str]]
BatchCall = Callable[[list[str]], Sequence[Sequence[float]]]


async def _one(call: Call, request: str, policy: Policy, gate: asyncio.Semaphore) -> tuple[str | None, int, str | None]:
    """Answer, tries, and the last error if there is no answer."""
    error = None
    for n in range(policy.attempts):
        if n:
            await asyncio.sleep(policy.wait * 2 ** (n - 1) * (0.75 + random.random() / 2))
        async with gate:
            try:
                made = call(request) if inspect.iscoroutinefunction(call) else asyncio.to_thread(call, request)
                return str(await asyncio.wait_for(made, policy.timeout)), n + 1, None
            except Exception as e:  # noqa: BLE001 - whatever a service raises counts as a failed try
                error = f"{type(e).__name__}: {e}"[:200]
    return None, policy.attempts, error


def _all(call: Call, requests: list[str], policy: Policy) -> list[tuple[str | None, int, str | None]]:
    async def run() -> list:
        gate = asyncio.Semaphore(policy.in_flight)
        return await asyncio.gather(*(_one(call, r, policy, gate) for r in requests))

    return asyncio.run(run())


def answers(requests: DataFrame, column: str, call: Call, policy: Policy | None = None, known: DataFrame | None = None) -> DataFrame:
    """(request, answer, tries, error) for each different request of a column, null ones left out.

    Requests that ``known`` (request, answer) has aren't made; they count as no tries. The others are called in the tasks where they are, ``policy.in_flight`` at a
    time in each, and their order within a task is kept. A request all of whose tries fail has a null answer and the last error: it costs nothing but itself.
    """
    policy = policy or Policy()
    asked = requests.select(F.col(column).alias("request")).where("request IS NOT NULL").distinct()
    schema = pa.schema([("request", pa.string()), ("answer", pa.string()), ("tries", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, policy.window):
                part = batch.column(0).slice(at, policy.window)
                told = _all(call, part.to_pylist(), policy)
                yield pa.RecordBatch.from_arrays([part.cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), list(schema)[1:], strict=True))], schema=schema)

    if known is None:
        return asked.mapInArrow(run, "request string, answer string, tries int, error string")
    held = known.select("request", "answer").where("answer IS NOT NULL").dropDuplicates(["request"])
    new = asked.join(held, "request", "left_anti").mapInArrow(run, "request string, answer string, tries int, error string")
    return asked.join(held, "request").select("request", "answer", F.lit(0).alias("tries"), F.lit(None).cast("string").alias("error")).unionByName(new)


def prompt(question: str, text: str) -> str:
    return f"How relevant is the passage to the question, from 1 to 10?\nQuestion: {question}\nPassage: {text}\nAnswer with a number."


def reranked(passages: DataFrame, call: Call, policy: Policy | None = None, question: str = "question", text: str = "text") -> DataFrame:
    """Passages with ``relevance_score`` by a model's answers, ``DEFAULT_SCORE`` where it fails or gives no number, and ``rank`` within their question: the best first, ties in order of all columns.

    Equal passages of a question are asked about once.
    """
    said = F.concat(F.lit(prompt("", "").split("\n")[0] + "\nQuestion: "), F.col(question), F.lit("\nPassage: "), F.substring(text, 1, PASSAGE_CHARS), F.lit("\nAnswer with a number."))
    rows = passages.withColumn("_request", said)
    told = answers(rows, "_request", call, policy).select(F.col("request").alias("_request"), F.coalesce(parsed_score(F.col("answer")), F.lit(DEFAULT_SCORE)).alias("relevance_score"))
    order = Window.partitionBy(question).orderBy(F.col("relevance_score").desc(), *passages.columns)
    scored = rows.join(told, "_request", "left").withColumn("relevance_score", F.coalesce("relevance_score", F.lit(DEFAULT_SCORE)))
    return scored.withColumn("rank", F.row_number().over(order)).drop("_request")


def embedded(texts: DataFrame, column: str, call: BatchCall, size: int = 64, attempts: int = 3, wait: float = 0.1) -> DataFrame:
    """(text, values) for each different text: vectors of a service that takes ``size`` texts at once. A batch that fails is tried again, at last text by text; a text that fails alone has null values."""
    schema = pa.schema([("text", pa.string()), ("values", pa.list_(pa.float32()))])

    def ask(given: list[str]) -> list[Sequence[float] | None]:
        try:
            out = list(retried(lambda: call(given), attempts, wait))
            if len(out) != len(given):
                raise ValueError(f"{len(out)} vectors for {len(given)} texts")
            return out
        except Exception:  # noqa: BLE001
            return [None] if len(given) == 1 else [x for t in given for x in ask([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.column(0).slice(at, size)
                yield pa.RecordBatch.from_arrays([part.cast(pa.string()), pa.array([None if v is None else list(map(float, v)) for v in ask(part.to_pylist())], schema.field(1).type)], schema=schema)

    return texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().mapInArrow(run, "text string, values array<float>")
