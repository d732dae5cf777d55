"""Reading and writing of extracted documents, files, vectors and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import document_id, document_type
from ledgerlens.schema import DOCUMENT, MANIFEST


def extracted(spark: SparkSession, folder: str, ticker: str | None = None) -> DataFrame:
    """One row for each extracted document (JSON file) of a folder but the manifest; broken files have ``broken`` set, their other columns null."""
    rows = spark.read.schema(f"{DOCUMENT}, broken string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken", pathGlobFilter="*.json").json(folder)
    rows = rows.withColumn("file_name", F.col("_metadata.file_name")).where("file_name <> 'manifest.json'")
    # Spark reads the column of broken records only together with others.
    rows = rows.withColumn("broken", F.when(F.col("document_id").isNull() | F.col("broken").isNotNull(), F.col("broken")))
    return rows.where(F.upper("file_name").startswith(ticker.upper())) if ticker else rows


def readable(documents: DataFrame) -> DataFrame:
    return documents.where("broken IS NULL").drop("broken")


def files(spark: SparkSession, folder: str, kind: str = "*.pdf") -> DataFrame:
    """(doc_id, doc_type, source_file, file_size_bytes, file_hash) of a folder's files; contents are hashed where they are read, and go no further."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", kind).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(document_id(name).alias("doc_id"), document_type(name).alias("doc_type"), name.alias("source_file"), F.col("length").alias("file_size_bytes"), F.md5("content").alias("file_hash"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, empty if there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path)


def write_documents(documents: DataFrame, folder: str) -> None:
    """A folder of JSON lines for each document; sets are arrays in order, times ISO text."""
    documents.write.mode("overwrite").partitionBy("document_id").json(folder)


def write_vectors(records: DataFrame, path: str) -> None:
    """Vectors by document, so that replacing one rewrites its own folder only."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]
