"""Language identification by n-gram filters with language bitmasks.

Learned are the byte 4-grams of texts (letters as they are, A-Z lower-cased, all other
ASCII a single space) that are common in a language: at least ``LEAST`` of its grams, and
at least ``SHARE`` of the gram's greatest frequency in any language. All languages share
one Bloom filter sliced by bit: each of its cells is a mask of languages, and the AND of a gram's
cells gives all languages that have it. A text's grams are looked up at once and counted for each
language; of each count the expected false positives, known from how full the slice
is, are taken off. The language with the most remaining wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import _arrow_schema, arrow_rows, stored

LEAST, SHARE, HASHES, UNKNOWN = 1e-5, 0.25, 3, "und"
#: Grams that a counting task holds before it passes them on.
HELD = 2_000_000
_LETTERS = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))
_LETTER = regex.compile(r"\p{L}")
_GAP = b"   "


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams without two spaces in a row, with the number of each one's text."""
    buffer = _GAP + _GAP.join(texts) + _GAP
    a = np.frombuffer(buffer, np.uint8)
    wide = a.astype(np.uint32)
    values = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    space = a == 32
    two = space[:-1] & space[1:]
    good = ~(two[:-2] | two[1:-1] | two[2:])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + len(_GAP) for t in texts])
    return values[good], owner[good]


def letters(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS)


def lettered(text: str | None) -> bool:
    """Whether a text has any letter; null has none."""
    return bool(text) and _LETTER.search(text) is not None


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows (text, lang), added up in each task before the shuffle, as far as ``HELD`` grams and some MB of text go."""
    schema = "lang string, gram bigint, n bigint"
    arrow, flush, most = _arrow_schema(labelled.sparkSession, schema), 2_000_000, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[bytes], int]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            values, n = np.unique(grams(held.pop(lang)[0])[0], return_counts=True)
            if lang in sums:
                old, m = sums[lang]
                both, where = np.unique(np.concatenate([old, values]), return_inverse=True)
                values, n = both, np.bincount(where, np.concatenate([m, n])).astype(np.int64)
            sums[lang] = values, n

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (values, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)
            sums.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts, size = held.get(lang, ([], 0))
                texts.append(letters(text))
                held[lang] = texts, size + len(texts[-1])
                if held[lang][1] > flush or sum(n for _, n in held.values()) > 4 * flush:
                    for some in [lang] if held[lang][1] > flush else list(held):
                        add(some)
                    if sum(len(v) for v, _ in sums.values()) > most:
                        yield from told()
        for lang in list(held):
            add(lang)
        yield from told()

    return labelled.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """``slices``: for each 64 languages one array of masks; ``false``: each language's share of grams found by chance."""

    langs: list[str]
    usual: str
    slices: list[np.ndarray]
    false: np.ndarray

    @staticmethod
    def _cells(values: np.ndarray, size: int) -> list[np.ndarray]:
        mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        first, step = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return [((first + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]

    @classmethod
    def of(cls, langs: list[str], usual: str, values: np.ndarray, lang: np.ndarray) -> LanguageModel:
        size = 1 << 12
        while size < 8 * len(np.unique(values)):
            size *= 2
        slices, false = [], np.zeros(len(langs))
        for at in range(0, max(len(langs), 1), 64):
            width = min(64, len(langs) - at)
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= width)
            table = np.zeros(size, kind)
            mine = (lang >= at) & (lang < at + width)
            bits = np.left_shift(np.uint64(1), (lang[mine] - at).astype(np.uint64)).astype(kind)
            for cells in cls._cells(values[mine], size):
                np.bitwise_or.at(table, cells, bits)
            for k in range(width):
                false[at + k] = np.count_nonzero(table >> kind(k) & kind(1)) / size
            slices.append(table)
        return cls(langs, usual, slices, np.minimum(false**HASHES, 0.999))

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the grams each language has, without those expected by chance."""
        values, owner = grams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        found = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.slices):
            masks = np.bitwise_and.reduce([table[c] for c in self._cells(values, len(table))])
            width = min(64, len(self.langs) - 64 * k)
            if width <= 8:
                table_of = np.bincount(owner.astype(np.int64) * 256 + masks, minlength=256 * len(texts)).reshape(-1, 256)
                found[:, 64 * k : 64 * k + width] = table_of @ (np.arange(256)[:, None] >> np.arange(width) & 1)
            else:
                for b in range(width):
                    found[:, 64 * k + b] = np.bincount(owner[(masks >> table.dtype.type(b) & table.dtype.type(1)).astype(bool)], minlength=len(texts))
        return np.maximum(0, (found - total[:, None] * self.false) / (1 - self.false))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A learned language and its share of all counts for each text; ``und`` and 0 for texts without letters.

        With no language learned, all texts are ``und``. Texts of which no gram is known get the most common language with score 0; ties go to the first in order.
        """
        if not texts:
            return [], []
        some = [lettered(t) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        counts = self.counts([letters(t) for t in texts])
        best, sums = counts.argmax(axis=1), counts.sum(axis=1)
        top = counts[np.arange(len(texts)), best]
        langs = [UNKNOWN if not s else self.langs[b] if c > 0 else self.usual for s, b, c in zip(some, best.tolist(), top.tolist(), strict=True)]
        return langs, [float(c / t) if s and t > 0 else 0.0 for s, c, t in zip(some, top.tolist(), sums.tolist(), strict=True)]


def learn(labelled: DataFrame) -> LanguageModel:
    """Learns from all rows (text, lang) whose lang isn't null. The driver gets at most 1 / LEAST grams for each language."""
    rows = labelled.select("text", "lang").where("lang IS NOT NULL")
    sizes = {r.lang: (r.n, r.rows) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()}
    if not sizes:
        return LanguageModel([], UNKNOWN, [], np.zeros(0))
    langs = sorted(sizes)
    usual = min(langs, key=lambda x: (-sizes[x][1], x))
    counts = stored(gram_counts(rows), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    rates = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("rate"))
    tops = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = rates.where(F.col("rate") >= LEAST).join(tops, "gram").where(F.col("rate") >= SHARE * F.col("top")).select("gram", "lang").toPandas()
    number = {x: i for i, x in enumerate(langs)}
    return LanguageModel.of(langs, usual, kept["gram"].to_numpy(np.int64), np.array([number[x] for x in kept["lang"]], np.int64))


def predictions(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row (doc_id, text); nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, out: list, texts: list) -> dict[str, list]:
        langs, scores = shared.value.predict(texts)
        return {"doc_id": ids, "held_out": out, "lang_pred": langs, "score": scores}

    return arrow_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: LanguageModel, lang: str = "lang") -> DataFrame:
    """The rows, all columns kept, of texts that have letters; where their language is null, it is the predicted one from now on.

    ``und`` with letters stays, unnamed: no language was learned, or one of that name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                langs, _ = shared.value.predict(texts)
                place = part.schema.get_field_index(lang)
                if place >= 0:
                    known = part.column(place).to_pylist()
                    named = pa.array([k if k is not None or x == UNKNOWN else x for k, x in zip(known, langs, strict=True)], part.schema.field(place).type)
                    part = part.set_column(place, part.schema.field(place), named)
                yield part.filter(pa.array([x != UNKNOWN or lettered(t) for x, t in zip(langs, texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
