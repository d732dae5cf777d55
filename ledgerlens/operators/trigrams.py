"""Names that hold a text, in any case, by a stored index of trigrams.

The index has, for each three characters in a row of a lower-cased name, the names that have them, sorted by these characters, so that a
lookup reads only the rows of the text's own trigrams. Names that have all of them are candidates, which are verified. A text
of fewer than three characters has no trigram: then all names are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3


def trigrams(text: Column) -> Column:
    """The different trigrams of a lower-cased text."""
    own = F.lower(text)
    places = F.when(F.length(own) >= SIZE, F.sequence(F.lit(1), F.length(own) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substr(own, i, F.lit(SIZE))))


def store_names(entities: DataFrame, folder: str, text: str = "text") -> None:
    """Writes the index of entities by their ``text``: postings (gram, entity) sorted by gram, and the entities themselves for short texts. Null texts are never found."""
    named = entities.where(F.col(text).isNotNull())
    rows = named.select(F.explode(trigrams(F.col(text))).alias("_gram"), F.struct("*").alias("_entity"))
    rows.repartitionByRange("_gram").sortWithinPartitions("_gram").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/grams")
    named.write.parquet(f"{folder}/names")


def names_with(spark: SparkSession, folder: str, asked: str, text: str = "text") -> DataFrame:
    """The entities whose name holds a text, as often as they were stored."""
    wanted = asked.lower()
    grams = sorted({wanted[i : i + SIZE] for i in range(len(wanted) - SIZE + 1)})
    holds = lambda c: F.contains(F.lower(c), F.lit(wanted))
    if not grams:
        return spark.read.parquet(f"{folder}/names").where(holds(F.col(text)))
    rows = spark.read.parquet(f"{folder}/grams").where(F.col("_gram").isin(*grams))
    # Equal entities have as many rows for each gram as there are of them.
    met = rows.groupBy("_entity").agg(F.count("*").alias("_n")).where(F.col("_n") >= len(grams))
    each = met.where(holds(F.col(f"_entity.{text}"))).withColumn("_copies", F.explode(F.sequence(F.lit(1), (F.col("_n") / len(grams)).cast("int"))))
    return each.select("_entity.*")


def candidates(spark: SparkSession, folder: str, asked: str) -> int:
    """How many postings a lookup reads."""
    wanted = asked.lower()
    return spark.read.parquet(f"{folder}/grams").where(F.col("_gram").isin(*{wanted[i : i + SIZE] for i in range(len(wanted) - SIZE + 1)})).count()
