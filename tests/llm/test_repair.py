from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerlens.llm import repair
from ledgerlens.llm.queries import op12_repair

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (1 + (fate == 3))
    return out


def plain_edits(rows):
    """Cheapest edits by listing, for each node and place, the least (cost, letters, turns); rows are (role, text, fault)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(3):
            for x, (cost, letters, turns) in list(best.items()):
                y = "a" if x == "u" else "u"
                new = (cost + 3, letters + "I", [*turns, ("user" if y == "u" else "assistant", "")])
                best[y] = min(best.get(y, new), new)
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def put(y, new):
            after[y] = min(after.get(y, new), new)

        for x, (cost, letters, turns) in best.items():
            put(x, (cost + 4, letters + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] and role[:1] in follow[x]:
                put(role[:1], (cost + more, letters + "K", [*turns, (role, text)]))
            for y in "ua":
                if y in follow[x]:
                    put(y, (cost + 3 + more, letters + "R", [*turns, ("user" if y == "u" else "assistant", text)]))
        best = inserted(after)
    return min(v for k, v in best.items() if k in ("", "a"))


def plain_audit(rows, every):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role, text, turn))
    out = {}
    for conv in every:
        own = sorted(talks[conv], key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, judged, counts = set(), [], defaultdict(int)
        for *_, role, text, _ in own:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault))
        turns = {r[4] for r in own} - {None}
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:], strict=False)]
        cost, letters, kept = plain_edits(judged)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha)
    return out


def random_rows(rng, convs, most):
    texts = ["Hi.", "Yes!", "why", "", " \t", None, "no \n", "ok?", " ", "é.", "a:b\nc."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(0, most)):
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else t + rng.randrange(2), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "sage"]), rng.choice(texts) if rng.random() < 0.5 else f"{rng.randrange(99)}."))
    return rows


def same(got, want):
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("rows_most", "bytes_most"), [(4_096, 1 << 20), (1, 1 << 20), (3, 4)])
def test_random_conversations(spark, monkeypatch, rows_most, bytes_most):
    monkeypatch.setattr(repair, "ROWS", rows_most)
    monkeypatch.setattr(repair, "BYTES", bytes_most)
    rows = random_rows(random.Random(rows_most), 60, 14) + [(70, i, ("user", "assistant")[i % 2], f"{i % 7}.") for i in range(60)] + [(71, 1, "user", "same.")] * 20
    schema = "conv_id long, turn long, role string, text string, key string, part int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    every = {r[0] for r in rows} | {1_000}
    more = df.unionByName(spark.createDataFrame([(1_000, None, None, None, None, None)], schema))
    hurt = repair.damaged(df)
    assert sorted(map(tuple, hurt.collect()), key=str) == sorted(plain_damage(rows), key=str)
    same(repair.audited(hurt, more).collect(), plain_audit(plain_damage(rows), every))
    blanks = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    same(repair.audited(df).collect(), plain_audit(blanks, {r[0] for r in rows}))
    turns = defaultdict(list)
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(turns[r.conv_id])
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    want = plain_audit(blanks, {r[0] for r in rows})
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op12_repair(spark, SF).collect(), plain_audit(plain_damage(given), {r[0] for r in given}))


def test_empty_tables_and_long_texts(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.audited(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 2_000_000)]
    same(repair.audited(spark.createDataFrame(rows, schema)).collect(), plain_audit(rows, {1}))
