from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm.packing import WordTokenizer, pack, pack_documents, pieces, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(8)
    bits = ["Straße", "ÉCOLE", "école.", "é", "J̌", "don't", "WE'LL", "...", "a.b,c", "3.14", "x²", "<|endoftext|>", "<|STARTOFTEXT|>", "日本語", " ", "\x1c", "İ", "ΑΣ", "naïve,", "ÿ", "Œuvre", "#!", "‍👍🏽", "<", "̸", "𝄞"]
    out = [None, "", " ", "\n\t", "word", " a b\x85c"]
    for _ in range(300):
        out.append(rng.choice(["", " "]).join(rng.choices([*bits, " ", "\n", "  ", "Hello", "hello,"], k=rng.randrange(1, 30))))
    return out


def test_ids_are_the_tokenizers():
    plain = Tokenizer.from_file(PATH)
    given = texts()
    want = [e.ids for e in plain.encode_batch([t or "" for t in given], add_special_tokens=False)]
    for most in (500_000, 50):
        tok = WordTokenizer(PATH, most)
        got = [np.frombuffer(d, "<u4").tolist() for at in range(0, len(given), 40) for d in tok.encode(given[at : at + 40])]
        assert got == want


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece: number of sequences."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            f = min(fits)
            free.remove(f)
            free.append(f - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.7 else rng.choice([1, 3, 5]) for _ in range(rng.randrange(1, 120))]
        used, ranks = {}, Counter()
        for length, first, n, each, start, offset in plan(Counter(lengths), capacity):
            assert first == ranks[length]
            for j in range(n * each):
                used.setdefault(start + j // each, []).append((offset + j % each * length, length))
            ranks[length] += n * each
        assert ranks == Counter(lengths)
        for slots in used.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(used) == list(range(len(used))) and len(used) == best_fit(lengths, capacity)


def test_documents(spark):
    given = [*texts()[:40], "many words " * 5000, "same text", "same text"]
    rows = [(i, t, 1) for i, t in enumerate(given)] + [(None, "same text", 1), (3, "x", 1), (3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    for most in (200_000, 0):
        got = pack(pieces(df, PATH), most_broadcast=most).collect() if not most else pack_documents(df, PATH).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert ends.get(r.sequence_id, 0) == r.offset
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r.length for r in got) // 4096)
    kept = pieces(df, PATH, keep_ids=True).where("doc_id = 41").first()
    assert zlib.crc32(bytes(kept.ids)) == kept.ids_crc32
    assert pack_documents(df.limit(0), PATH).count() == 0
