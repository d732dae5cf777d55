"""From a question to SQL, rows and text, and a small dispatcher over tools."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from ledgerlens.operators import guard
from ledgerlens.providers import TemplateSql


def clean_sql(answer: str) -> str:
    """A model's answer without the marks of a code block."""
    text = answer.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1] if "\n" in text else text.strip("`")
        text = text.rsplit("```", 1)[0]
    return text.strip()


def ask(spark: SparkSession, question: str, provider: TemplateSql | None = None, seconds: float = guard.SECONDS) -> str:
    """The answer to a question about the metrics tables, with the query used."""
    question = question.strip()
    if not 1 <= len(question) <= 1024:
        raise ValueError("a question has 1 to 1024 characters")
    sql = clean_sql((provider or TemplateSql()).sql(question))
    if why := guard.validate(sql, spark):
        raise guard.Rejected(why)
    rows = guard.collect(guard.run(spark, sql), seconds)
    return guard.formatted(rows, guard.sanitised(sql))


Tool = Callable[..., object]


def arguments_of(call: dict) -> tuple[str, dict]:
    """Name and arguments of a tool call, these given as a mapping or as JSON text."""
    given = call.get("args", call.get("arguments")) or {}
    return call.get("name", ""), json.loads(given) if isinstance(given, str) else dict(given)


def run_tools(tools: dict[str, Tool], calls: list[dict]) -> list[dict]:
    """One row (tool, status, content) for each call, in order; an error is a row too."""
    out = []
    for call in calls:
        try:
            name, arguments = arguments_of(call)
        except ValueError as e:
            out.append({"tool": call.get("name", ""), "status": "error", "content": f"bad arguments: {e}"})
            continue
        if name not in tools:
            out.append({"tool": name, "status": "error", "content": f"unknown tool: {name}"})
            continue
        try:
            found = tools[name](**arguments)
            out.append({"tool": name, "status": "ok", "content": found if isinstance(found, str) else json.dumps(found, default=str)})
        except Exception as e:  # the next call still runs
            out.append({"tool": name, "status": "error", "content": str(e)})
    return out
