"""Best-fit packing, planned over a histogram of lengths.

Documents become token ids, longer ones are cut into pieces of the capacity. Only the
histogram of piece lengths, no more than ``capacity`` counts, comes to the driver. There
best-fit decreasing runs over counts: the sequences are kept as runs of equal free
space, and all pieces of a length fill the tightest runs at once. The plan says which ranks
of a length go to which sequences. Each piece finds its slot by its rank within its
length, a join on length and rank range.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, salts, stored

CAPACITY, END = 4096, 1


class WordTokenizer:
    """Ids of the word BPE, by way of the words that were met before.

    Its pre-tokenizer parts words at white space, and letters from punctuation, and gives each
    word's last token a mark of its own, so that a text's ids are those of its chunks in a row.
    Chunks end at white space and before a full stop or comma between a letter and white space; A-Z are
    put in lower case first, unless a special token or a combining mark could make that matter.
    Chunks are remembered in a table of at most ``most`` entries, emptied when full. New chunks of plain letters
    are encoded many at a time and parted after the marked tokens.
    """

    #: Letters of ASCII and Latin-1, which have no other composed form.
    _LETTER = rb"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
    PLAIN = re.compile(rb"(?:" + _LETTER + rb")+")
    STOP = re.compile(rb"[.,](?=[ \n])(?:(?<=[A-Za-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.inner, self.most = Tokenizer.from_file(path), most
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.inner.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def chunks(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
            raw = raw.lower()
        return self.STOP.sub(rb" \g<0>", raw).split()

    def learn(self, chunks: set[bytes]) -> None:
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, chunks
        match = self.PLAIN.fullmatch
        plain = list(filter(match, new))
        for at in range(0, len(plain), 512):
            group = plain[at : at + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(group).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            self.known.update(zip(group, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        other = list(new.difference(plain))
        for at in range(0, len(other), 512):
            group = other[at : at + 512]
            found = self.inner.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in group], add_special_tokens=False)
            self.known.update(zip(group, (array("I", e.ids).tobytes() for e in found), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        chunks = list(map(self.chunks, texts))
        self.learn(set().union(*chunks))
        get = self.known.__getitem__
        for c in chunks:
            yield b"".join(map(get, c))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and the ids themselves if ``keep_ids``."""
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordTokenizer(tokenizer))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for i, data in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist()), strict=True):
                    data += end
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[s : s + 4 * capacity]
                        out.append((i, k, s // 4, len(cut) // 4, zlib.crc32(cut), cut))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=False)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, sequences, pieces in each, first sequence, offset).

    The pieces of such a row have ranks from ``first rank`` on; each run of ``pieces in
    each`` of them fills one of the sequences from ``offset`` on.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: runs (first sequence, sequences)
    spaces: list[int] = []
    opened, out = 0, []

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(at)
            each = space // length
            whole = min(n, left // each)
            if whole:
                out.append((length, rank, whole, each, first, capacity - space))
                put(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
                first, n = first + whole, n - whole
            if n and left and left < each:
                out.append((length, rank, 1, left, first, capacity - space))
                put(space - left * length, first, 1)
                rank, left = rank + left, 0
                first, n = first + 1, n - 1
            put(space, first, n)
    return out


def pack(found: DataFrame, capacity: int = CAPACITY, most_broadcast: int = 200_000) -> DataFrame:
    """Gives each piece (column ``length``, unique by ``doc_id`` and ``piece`` or not) its ``sequence_id`` and ``offset``.

    Ranks are counted in parts of each length, as many as the number of all pieces asks for, so that a length of very many pieces is
    no single task. The first ranks of the parts are joined where the ranks are: both are dealt by length and part.
    """
    spark = found.sparkSession
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts(found.count()))).cast("int"))
    counts = stored(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "length-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    planned = spark.createDataFrame(slots, "_length bigint, _from bigint, _sequences bigint, _each bigint, _first bigint, _offset bigint")
    if len(slots) <= most_broadcast:
        planned = F.broadcast(planned)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "_salt", before.alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_rank", rank).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base") - 1)
    at = F.col("_rank") - F.col("_from")
    placed = ranked.join(planned, (F.col("length") == F.col("_length")) & (at >= 0) & (at < F.col("_sequences") * F.col("_each")))
    return placed.select(
        *found.columns,
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most ``capacity`` tokens: one row for each piece.

    A null text is an empty one, whose only token is the end mark. Repeated rows are packed each; an empty table gives no rows.
    """
    return pack(stored(pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)
