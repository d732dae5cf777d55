from __future__ import annotations

import hashlib
import random

from ledgerlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def plain(rows):
    out = {}
    talks = {}
    for c, t, r, x, *_ in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in talks.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(3)
    bits = ["\\", "<", ">", "</turn>", "<and>", "<turn:user>", "\\l", "\\b", "\\g", "é", "𝄞", "\n", "", "ok", " ", "b", "l", "\\\\"]
    rows = [
        (rng.randrange(12), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["user", "assistant", "system", None, "a>b<\\", ""]), rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(9)))]), "x", 1)
        for _ in range(150)
    ]
    rows += [(None, 0, "user", "no id", "x", 1), (99, 0, "assistant", "y" * 200_000, "x", 1), (98, 0, None, None, None, None)]
    rows += rows[:20]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == plain(rows)


def test_layout_and_mask(spark):
    rows = [(1, 0, "user", "a<"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c\\"), (1, 3, "user", "d")]
    row = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert row.formatted == "<turn:user>a\\l</turn><turn:assistant>b<and>c\\b</turn><turn:user>d</turn>"
    at, masked = 0, []
    for run in row.loss_runs:
        if run.loss:
            masked.append(row.formatted[at : at + run.chars])
        at += run.chars
    assert at == len(row.formatted) and masked == ["b", "c\\b"]


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_no_python_in_plan(spark):
    df = chat.digests(chat.format_chats(spark.createDataFrame([(1, 0, "u", "t")], "conv_id long, turn long, role string, text string")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
