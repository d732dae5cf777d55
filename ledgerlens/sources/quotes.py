"""A Spark data source of quotes: ``spark.read.format("quotes").option("tickers", "AAA,BBB").load()``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Batch(InputPartition):
    def __init__(self, tickers: list[str]):
        self.tickers = tickers


class QuotesReader(DataSourceReader):
    def __init__(self, tickers: list[str], size: int):
        self.tickers, self.size = tickers, size

    def partitions(self) -> list[InputPartition]:
        return [Batch(self.tickers[i : i + self.size]) for i in range(0, len(self.tickers), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for t in partition.tickers:  # type: ignore[attr-defined]
            yield t, 123.45, 1.23, 1.01, 1_000_000, "mock"


class Quotes(DataSource):
    """One request for each batch of symbols; without a service, fixed quotes."""

    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "ticker string, price double, change double, change_percent double, volume bigint, source string"

    def reader(self, schema: object) -> DataSourceReader:
        tickers = [t.strip().upper() for t in self.options.get("tickers", "").split(",") if t.strip()]
        if not tickers:
            raise ValueError("no tickers")
        return QuotesReader(tickers, int(self.options.get("batch", "50")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Quotes)
