from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import linededup
from ledgerlens.llm.linededup import CuckooFilter, Full, LineIndex, clean_lines, line_digests

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(LOWER)


def plain(docs):
    """doc_id -> text left, lines, lines dropped."""
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    lines = ["", "short", "exactly 10", "éééééééééé", "ééééé", "  Padded Line Here\t", "padded line here", "\xa0padded line here", "a common line of text", "A COMMON LINE OF TEXT ", *(f"line number {i} of many" for i in range(60))]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 9)))) for i in range(0, 160, 2)]
    return [*docs, (1001, None), (1003, ""), (1005, "x" * 100_000 + "\na common line of text"), (1007, "\n\n")]


def digests(rows):
    return sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in rows)


def test_digests(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id long, text string, n long, cells binary")
    assert sorted(tuple(r) for r in line_digests(df).collect()) == digests(plain(docs))
    assert line_digests(df.limit(0)).count() == 0


def test_any_number_of_shards_and_more_columns(spark):
    docs = corpus(2)
    df = spark.createDataFrame([(i, t, "k", 5, 6) for i, t in docs], "doc_id long, text string, key string, _gone long, _line_id long")
    few = sorted(tuple(r) for r in LineIndex.empty(spark, 8).insert(df).duplicates(df).collect())
    assert few and few == sorted(tuple(r) for r in LineIndex.empty(spark, 1).insert(df).duplicates(df).collect())
    cleaned = clean_lines(df)
    assert cleaned.columns == df.columns
    left = {r.doc_id: r for r in cleaned.collect()}
    assert {i: r.text for i, r in left.items()} == {i: (None if dict(docs)[i] is None else t) for i, t, *_ in plain(docs)}
    assert all((r.key, r["_gone"], r["_line_id"]) == ("k", 5, 6) for r in left.values())


def test_a_very_common_line_and_a_very_long_text(spark):
    """The common line's rows are dealt to several tasks; the text has 300,000 lines of its own and one of the others' lines."""
    docs = [(i, f"the line that all documents have\nline number {i} of one document\nline of half {i % 2}") for i in range(3000)]
    docs.append((5000, "\n".join(f"long text line {i:09d}" for i in range(300_000)) + "\nThe line that all documents have "))
    got = sorted(tuple(r) for r in line_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == digests(plain(docs))


def test_an_id_of_the_largest_number_is_no_null(spark):
    docs = [(2**63 - 1, "a line in two documents"), (None, "a line in two documents")]
    got = {r.doc_id: r.n_dropped for r in line_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: 0, None: 1}


def test_deleting_what_is_not_there_is_an_error(spark):
    one = spark.createDataFrame([(1, "a line of some document")], "doc_id long, text string")
    other = spark.createDataFrame([(2, "a line of another document")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't hold"):
        LineIndex.empty(spark, 8).insert(one).delete(other)


def test_repeated_and_null_ids(spark):
    docs = [(None, "a line in many documents"), (None, "a line in many documents"), (4, "a line in many documents\nmy own, twice here"), (4, "my own, twice here")]
    got = sorted(((r.doc_id or 99, r.n_dropped) for r in line_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(4, 0), (4, 0), (99, 1), (99, 1)]


def test_deletion_undoes_insertion(spark):
    docs = corpus(3)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    one, two = docs[:50], docs[50:]
    index = LineIndex.empty(spark, 8).insert(make(one)).insert(make(two)).delete(make(one))
    fresh = LineIndex.empty(spark, 8).insert(make(two))
    assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
    assert sorted(map(tuple, index.duplicates(make(two)).collect())) == sorted(map(tuple, fresh.duplicates(make(two)).collect()))
    shared = [(r.hi, r.lo) for r in index.counts.where("n >= 2").collect()]
    held = {r.shard: CuckooFilter(np.frombuffer(bytes(r.cells), np.uint16)) for r in index.filters.collect()}
    for hi, lo in shared:
        assert held[(hi & 0xFFFFFFFF) % 8].may_hold(np.array([hi]), np.array([lo])).all()
    assert sum(int((f.cells > 0).sum()) for f in held.values()) == len(shared)


def test_batch_is_judged_against_older_documents(spark):
    docs = sorted(corpus(4)) + [(2001, "line number 1 of many\nonly in the last text"), (2003, "only in the last text")]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t for i, t, *_ in plain(docs)}
    index = LineIndex.empty(spark, 8)
    for part in (docs[:40], docs[40:70], docs[70:]):
        index = index.insert(make(part))
        got = {r.doc_id: r.text or "" for r in clean_lines(make(part), index=index, batch=True).collect()}
        assert got == {i: want[i] for i, _ in part}
    assert {r.doc_id: r.text or "" for r in clean_lines(make(docs), index=index).collect()} == want


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    f = CuckooFilter.of(hi, lo)
    assert f.may_hold(hi, lo).all() and int((f.cells > 0).sum()) == 3000
    others = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert f.may_hold(*others).mean() < 0.005
    f.remove(hi[:2000], lo[:2000])
    assert f.may_hold(hi[2000:], lo[2000:]).all() and f.may_hold(hi[:2000], lo[:2000]).mean() < 0.01
    assert int((f.cells > 0).sum()) == 1000
    tight = CuckooFilter(np.zeros(4 * 1024, np.uint16))
    tight.add(hi[:2900], lo[:2900])
    tight.add(hi[2900:], lo[2900:])
    assert tight.may_hold(hi, lo).all()
    with pytest.raises(Full):
        CuckooFilter.sized(1).add(np.arange(100) << 50, np.arange(100))
    with pytest.raises(KeyError):
        CuckooFilter.sized(9).remove(hi[:1], lo[:1])
    assert linededup.SHARED == 2
