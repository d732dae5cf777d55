"""What models and services do, behind small interfaces with defaults that need no network.

A default is a plain, repeatable stand-in of the right form, not an imitation of a model's answers.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import bucket, tokens

T = TypeVar("T")
DIMENSION = 1024


def retried(call: Callable[[], T], attempts: int = 3, wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's value, tried up to ``attempts`` times with waits that double."""
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n == attempts - 1:
                raise
            sleep(wait * 2**n)
    raise ValueError("attempts must be positive")


@dataclass
class Cache:
    """The last ``most`` values; hits and misses are counted. With ``touch``, a hit makes a value young again."""

    most: int
    touch: bool = True
    hits: int = 0
    misses: int = 0
    held: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str, make: Callable[[], T]) -> T:
        if key in self.held:
            self.hits += 1
            if self.touch:
                self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        value = self.held[key] = make()
        if len(self.held) > self.most:
            self.held.popitem(last=False)
        return value

    @property
    def rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


class Embedder(Protocol):
    dimension: int

    def column(self, text: Column) -> Column: ...


@dataclass
class HashedTerms:
    """A text's vector: signed counts of its terms by hash, of length one. Runs in the JVM."""

    dimension: int = DIMENSION

    def column(self, text: Column) -> Column:
        terms = F.transform(tokens(text), lambda t: F.struct((bucket(t) % self.dimension).cast("int").alias("i"), F.when(F.crc32(t.cast("binary")) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: F.aggregate(F.filter(terms, lambda t: t["i"] == i), F.lit(0.0), lambda a, t: a + t["s"]))
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, t: a + 1.0))
        return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))

    def embed(self, text: str) -> list[float]:
        """One vector on the driver, for queries."""
        from ledgerlens.functions.text import SHORTEST, STOPWORDS

        words = [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) >= SHORTEST and w not in STOPWORDS]
        out = [0.0] * self.dimension
        import zlib

        for w in words:
            i = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 2147483647 % self.dimension
            out[i] += 1.0 if zlib.crc32(w.encode()) % 2 == 0 else -1.0
        return [x / len(words) ** 0.5 for x in out] if words else out


@dataclass(frozen=True)
class Analysis:
    """A question, its variants (the question itself first), and whether it asks for relations."""

    variants: list[str]
    complex: bool


def distinct_variants(question: str, answers: list[str], most: int = 3) -> list[str]:
    """The question and up to ``most`` others of more than five characters, each once in any case."""
    out, seen = [question], {question.strip().lower()}
    for a in answers:
        key = a.strip().lower()
        if len(a.strip()) > 5 and key not in seen and len(out) <= most:
            out.append(a.strip())
            seen.add(key)
    return out


class RuleAnalyst:
    """Variants by rule: the question's search terms, and these in order."""

    _RELATION = re.compile(r"\b(relat|compet|connect|between|depend|supplier|partner|compare)", re.I)

    def __init__(self) -> None:
        self.cache = Cache(100, touch=False)

    def analyse(self, question: str) -> Analysis:
        question = question[:500]

        def make() -> Analysis:
            from ledgerlens.functions.text import STOPWORDS

            words = [w for w in re.findall("[A-Za-z0-9]+", question) if w.lower() not in STOPWORDS]
            return Analysis(distinct_variants(question, [" ".join(words), " ".join(sorted(words, key=str.lower))]), bool(self._RELATION.search(question)))

        return self.cache.get(question, make)


def overlap_score(question: str, text: Column) -> Column:
    """Relevance from 1 to 10: the share of the question's terms that a text has."""
    asked = F.array_distinct(tokens(F.lit(question)))
    share = F.size(F.array_intersect(asked, tokens(F.substring(text, 1, 2000)))) / F.greatest(F.size(asked), F.lit(1))
    return 1.0 + F.round(9 * share, 2)


def compressed(question: str, text: Column) -> Column:
    """The sentences of a text that have a term of the question; ``NOT_RELEVANT`` if none has."""
    asked = F.array_distinct(tokens(F.lit(question)))
    kept = F.filter(F.split(F.substring(text, 1, 4500), r"(?<=[.!?])\s+"), lambda s: F.arrays_overlap(tokens(s), asked))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise("NOT_RELEVANT")


class TemplateSql:
    """Questions to SQL by a few templates, for use without a model."""

    _METRICS = {"revenue": "revenue", "income": "net_income", "profit": "net_income", "margin": "gross_margin", "assets": "total_assets", "eps": "earnings_per_share"}

    def sql(self, question: str) -> str:
        said = question.lower()
        metric = next((c for w, c in self._METRICS.items() if w in said), "revenue")
        year = re.search(r"\b(20\d\d)\b", said)
        ticker = re.search(r"\b([A-Z]{2,5})\b", question)
        where = [*([f"fm.fiscal_year = {year[1]}"] if year else []), *([f"c.ticker = '{ticker[1]}'"] if ticker else [])]
        order = "ASC" if re.search(r"\b(lowest|smallest|least)\b", said) else "DESC"
        return (
            f"SELECT c.ticker, c.name, fm.fiscal_year, fm.{metric} FROM companies c JOIN financial_metrics fm ON c.id = fm.company_id"
            + (f" WHERE {' AND '.join(where)}" if where else "")
            + f" ORDER BY fm.{metric} {order} NULLS LAST, c.ticker LIMIT {1 if re.search('highest|largest|most|lowest|smallest|least', said) else 10}"
        )


def quotes_of(asked: DataFrame, column: str) -> DataFrame:
    """(ticker, price, change, change_percent, volume, timestamp, source): a fixed quote for each symbol of a column once, for use without a service; blank ones have none."""
    symbols = asked.select(F.upper(F.trim(F.col(column))).alias("ticker")).where("ticker <> ''").distinct()
    fixed = {"price": 123.45, "change": 1.23, "change_percent": 1.01, "volume": F.lit(1_000_000).cast("bigint"), "timestamp": F.lit(None).cast("string"), "source": "mock"}
    return symbols.select("ticker", *((v if not isinstance(v, float | str) else F.lit(v)).alias(c) for c, v in fixed.items()))


def quotes(spark: SparkSession, tickers: list[str]) -> DataFrame:
    """``quotes_of`` a list of symbols."""
    if not any(t.strip() for t in tickers):
        raise ValueError("no tickers")
    return quotes_of(spark.createDataFrame([(t,) for t in tickers], "symbol string"), "symbol")


def parsed_quotes(raw: DataFrame) -> DataFrame:
    """Quotes of a service's rows (symbol, price, change, changePercentage, volume, timestamp in seconds)."""
    from ledgerlens.functions.text import epoch_text

    return raw.select(F.col("symbol").alias("ticker"), "price", "change", F.col("changePercentage").alias("change_percent"), "volume", epoch_text(F.col("timestamp")).alias("timestamp"), F.lit("live").alias("source"))


def web_results_of(asked: DataFrame, column: str, most: int = 3) -> DataFrame:
    """The rows with (title, snippet, url) of each question's results, ``most`` of them (from 1 to 10) and never more than three, for use without a service."""
    number = F.explode(F.sequence(F.lit(1), F.lit(min(3, max(1, min(10, most))))))
    said, n = F.col(column), F.col("_n").cast("string")
    rows = asked.withColumn("_n", number)
    return rows.withColumns({"title": F.concat(F.lit("Result "), n, F.lit(" for "), said), "snippet": F.concat(F.lit("A passage on "), said, F.lit(".")), "url": F.concat(F.lit("https://example.com/"), n)}).drop("_n")


def web_results(spark: SparkSession, question: str, most: int = 3) -> DataFrame:
    """``web_results_of`` one question."""
    return web_results_of(spark.createDataFrame([(question,)], "question string"), "question", most).drop("question")


def parsed_results(raw: DataFrame, most: int = 5) -> DataFrame:
    """Results of a service's rows (title, content, url), nulls as ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(text("title").alias("title"), text("content").alias("snippet"), text("url").alias("url")).limit(max(1, min(10, most)))
