"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, linededup, packing, simhash
from ledgerlens.llm.common import drop_tables, fresh, recorded, stored
from ledgerlens.llm.queries import language_model, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts have no letters go, whether or not a language could be learned; those without a language get the predicted one."""
    return langid.identified(docs, language_model(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has are taken out of the texts."""
    return linededup.clean_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays, ids of null counting as largest; of repeated rows, one stays."""
    names = [fresh(x, docs) for x in ("_none", "_id", "_hash")]
    keys = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), F.xxhash64("text")]
    groups = simhash.near_duplicates(docs.select(F.struct(*(k.alias(n) for k, n in zip(keys, names, strict=True))).alias("own"), "text"), "own", "text")
    kept = groups.where("doc_id = component_id").select(*(F.col(f"doc_id.{n}").alias(n) for n in names)).distinct()
    keyed = docs.withColumns(dict(zip(names, keys, strict=True))).join(kept, names, "left_semi")
    number = fresh("_number", keyed)
    first = F.row_number().over(Window.partitionBy(*names).orderBy("lang", "source"))
    return keyed.withColumn(number, first).where(F.col(number) == 1).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Fingerprints, language models and token ids are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's output written and read again; what a stage has read and its own scratch tables go once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(spark, [*before, *made[:-1]])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
