from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import alignment
from ledgerlens.llm.alignment import B_BITS, Aligner, alignments, counted, encoded, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "Hello", "wörld", " ", "\n", "  ", "\t", "\r\n", ";", ".", ",", "×.", "².", "'s", "日本", "▁", "\xa0", "\x85", "x́", "<s>", "<|endoftext|>", "123", "½", "...", "\x00", "ﬁ", "😀", "\n\n", " the", " of"]


@pytest.fixture(scope="module")
def plain():
    """Each text's groups, by whole texts and sets of offsets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes = Aligner(A, B).a_bytes

    def groups(text):
        if not text:
            return []
        ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        raw = [[a_bytes[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        if any(b"".join(side) != f" {text}".encode() for side in raw):
            return []
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in raw]
        both = sorted(set(ends[0]) & set(ends[1]))
        out = [([], []) for _ in both]
        for k in (0, 1):
            for i, e in zip(ids[k], ends[k], strict=True):
                out[bisect_left(both, e)][k].append(i)
        return out

    return groups


def texts(n=400):
    rng = random.Random(5)
    return [None, "", " ", "\n", "a  b ", "same words here", "same words here"] + ["".join(rng.choices(BITS, k=rng.randrange(1, 14))) for _ in range(n)]


def test_units_give_what_whole_texts_give(plain):
    given = texts(3_000)
    for most in (500_000, 20):
        aligner = Aligner(A, B, most)
        assert aligner.cuts and aligner.fast is not None
        for at in range(0, len(given), 100):
            rows, (pair, owner, times) = aligner.batch(given[at : at + 100])
            want = Counter()
            for k, (text, row) in enumerate(zip(given[at : at + 100], rows, strict=True)):
                own = plain(text)
                links = [x << B_BITS | y for left, right in own for x in left for y in right]
                want.update((k, link) for link in links)
                said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
                assert row == (sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(links), said)
            assert Counter(dict(zip(zip(owner.tolist(), pair.tolist(), strict=True), times.tolist(), strict=True))) == want


def test_other_encoders_of_the_same_vocabulary():
    aligner = Aligner(A, B)
    given = [t for t in texts() if t]
    want = aligner.batch(given)[0]
    other = Aligner(A, B)
    other.fast, other.cuts = None, False
    assert other.batch(given)[0] == want


def test_documents_against_plain_counts(spark, plain, monkeypatch):
    given = [*texts(150), "the cat sat. " * 300]
    rows = [(i if i != 9 else None, t, 7, "x") for i, t in enumerate(given)] + [(3, "same words here", 7, "x"), (3, "same words here", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, batch int, stripe string").repartition(3)
    links, held = [], Counter()
    for _, t, *_ in rows:
        own = [(x, y) for left, right in plain(t) for x in left for y in right]
        links.append(own)
        held.update(set(own))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = Counter()
    for (i, t, *_), own in zip(rows, links, strict=True):
        groups = plain(t)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        want[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own), sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), sha] += 1
    for size, batches, entries in ((4 << 20, 64, 1 << 22), (60, 2, 50)):
        monkeypatch.setattr(alignment, "BATCH_BYTES", size)
        monkeypatch.setattr(alignment, "LANE_BATCHES", batches)
        monkeypatch.setattr(alignment, "HELD", entries)
        got = alignments(df, A, B).collect()
        assert Counter(map(tuple, got)) == want
    counts = pair_counts(counted(encoded(df, A, B))).collect()
    assert {(r.a, r.b): r.docs for r in counts} == held and len(counts) == len(held)
    assert all(r.best == (r.docs == best[r.a]) for r in counts)


def test_groups_and_empty_tables(spark, plain):
    df = spark.createDataFrame([("x", "Hello wörld.\nÉtion dans"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r.groups for r in alignments(df, A, B, keep_groups=True).collect()}
    assert got == {"x": ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in plain("Hello wörld.\nÉtion dans")), None: ""}
    assert alignments(df.limit(0), A, B).count() == 0
