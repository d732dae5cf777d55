"""What the corpus operators share: kept and scratch tables, Arrow helpers, joins on hot keys and components.

A table that is read more than once within an operator is kept on the executors' disks; what a lost
executor kept is computed again from its lineage, which is short. Where lineage and plans would grow, a scratch table ends them.
Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every
executor sees. Only a local session without that setting (a test) gets a local folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH = "ledgerlens-scratch"
_APPS: set[str] = set()
_RECORDS = threading.local()
_KEPT: list[DataFrame] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="ledgerlens-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    context.setCheckpointDir(f"file://{local}")
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which ends its lineage.

    A lost executor costs no more than the stage that runs then. The files stay
    until ``drop_scratch`` or the end of the driver, since the caller's plan still reads them.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in getattr(_RECORDS, "open", ()):
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Writes a table into the shared folder as ``stored`` does, in buckets of its keys, so that joins on all of these read it without a shuffle."""
    spark = df.sparkSession
    table = f"ledgerlens_{name}_{uuid.uuid4().hex}"
    path = f"{_scratch(spark)}/{table}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(table)
    for made in getattr(_RECORDS, "open", ()):
        made.append(path)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only the catalog's entry: the plan knows the files
    return found


def kept(df: DataFrame) -> DataFrame:
    """Keeps a table on the executors' disks, as it is first read, to be read again; nothing is written to the shared folder, and lineage stays.

    It stays until ``drop_scratch`` or the end of the application. Each call's table is its own, so that none is taken for an older one over files that have changed.
    """
    df = df.where(F.lit(uuid.uuid4().hex).isNotNull()).persist(StorageLevel.DISK_ONLY)
    _KEPT.append(df)
    for made in getattr(_RECORDS, "open", ()):
        made.append(df)
    return df


def _scratch(spark: SparkSession) -> str:
    """This application's own folder, which goes with its driver."""
    app = spark.sparkContext.applicationId
    if app not in _APPS:
        _APPS.add(app)
        atexit.register(drop_scratch, spark)
    return f"{shared_folder(spark)}/{SCRATCH}/{app}"


@contextmanager
def recorded() -> Iterator[list[str | DataFrame]]:
    """Lists the scratch tables (their paths) and kept tables that this thread makes meanwhile, so that the caller can drop those it doesn't need."""
    made: list[str | DataFrame] = []
    _RECORDS.open = [*getattr(_RECORDS, "open", ()), made]
    try:
        yield made
    finally:
        _RECORDS.open = [x for x in _RECORDS.open if x is not made]


def drop_tables(spark: SparkSession, tables: list[str | DataFrame]) -> None:
    """Deletes scratch tables and lets kept tables go; a plan that still reads a kept one computes it again."""
    context = spark.sparkContext
    for table in tables:
        if isinstance(table, str):
            path = context._jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        else:
            table.unpersist()
            _KEPT[:] = [t for t in _KEPT if t is not table]


def drop_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables and lets go what it kept; call it when no result is still to be read."""
    if spark.sparkContext._jsc is not None:
        drop_tables(spark, [_scratch(spark), *_KEPT])
    _KEPT.clear()


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle; deployments set it to the size of their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch on its way to Python. Spark's default would keep tens of MB of texts at once in each task, in the JVM and in Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Puts the session's Arrow batches from Spark's default size to ``BATCH_BYTES``; a size that the user chose stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864"):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def arrow_rows(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """Maps column lists to column lists, at most ``rows`` rows at a time.

    ``fn`` takes one Python list for each column of ``df`` and returns a list for each
    column of ``schema``. Small slices bound the memory of a Python worker.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(spark)
    return to_arrow_schema(StructType.fromDDL(ddl))


#: A key with more rows than one of ``HOT`` equal shares of a table is hot, so there are fewer than ``HOT`` of them; none with ``FEW`` rows or less is.
HOT, FEW = 1000, 200


def dealt(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Both tables with a column ``_task``: hot keys of ``left`` are dealt to several tasks, and their rows of ``right`` go to each of these; None if there are no hot keys.

    See ``spread_join``.
    """
    total = left.count() if total is None else total
    limit = max(FEW, total // HOT)
    if total <= limit:
        return None
    counted = left.groupBy(*on).agg(F.count("*").alias("n")) if sizes is None else sizes
    found = counted.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_tasks"))
    rows = found.collect()
    if not rows:
        return None
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, found.schema))
    parts = left.join(hot, on, "left").select(*left.columns, F.pmod(F.xxhash64(*left.columns), F.coalesce("_tasks", F.lit(1))).cast("int").alias("_task"))
    copies = right.join(hot, on, "left").select(*right.columns, F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)).alias("_task"))
    return parts, copies


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", sizes: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key at most, so that no key's rows meet in one task.

    The rows of a hot key in ``left`` are dealt to several tasks by a hash of all their columns, and its row
    of ``right`` goes to each of these. Which keys are hot is counted beforehand; only they come to the driver and are broadcast, about
    ``HOT`` of them at most, and copies of rows of ``right`` are at most about 2 x ``HOT``. ``how`` is ``inner`` or ``left``.
    ``left`` is read more than once. ``sizes`` has the rows of each key of ``left`` as ``n``, and ``total`` is no less than all of them, if these are known.
    """
    both = dealt(left, right, on, sizes, total)
    if both is None:
        return left.join(right, on, how)
    return both[0].join(both[1], [*on, "_task"], how).drop("_task")


#: Rows of a group that are numbered in one task.
NUMBERED = 250_000


def salts(rows: int) -> int:
    """Parts that the rows of a group are numbered in, so that none has many more than ``NUMBERED``, even if one group has all the rows."""
    return max(1, -(-rows // NUMBERED))


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, with underscores added until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, name: str = "components", most: int = 200) -> DataFrame:
    """Components of the undirected graph with edges (a, b), both long.

    Returns (node, component), the component being its smallest node, for every node
    that has an edge to another. Alternates large-star and small-star steps, which end in stars after a
    number of rounds that is logarithmic in practice; if they haven't after ``most`` rounds, it raises. Each round is written to the
    shared folder, which ends lineage; no edges come to the driver. Neighbours of a node with very many of
    them are dealt to several tasks.
    """
    edges, before = stored(_canonical(edges), f"{name}-edges"), None
    for turn in range(most):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        with recorded() as made:
            large = kept(_large_star(edges, now[0]))
            edges = stored(_canonical(_small_star(large, 2 * now[0])), f"{name}-{turn}")
        drop_tables(edges.sparkSession, made[:-1])
    else:
        raise RuntimeError(f"components haven't settled after {most} rounds")
    stars = edges.select(F.col("a").alias("component"), F.col("b").alias("node"))
    return stars.select("node", "component").union(stars.select("component", "component").distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, the smaller node as ``a``; loops go."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of them all and the node itself; of ``n`` edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = spread_join(both, near.select("a", F.least("a", "m").alias("m")), ["a"], sizes=near.select("a", "n"), total=2 * n)
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these; of at most ``n`` edges."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = near.select("a", "m")
    joined = spread_join(down, least, ["a"], sizes=near.select("a", "n"), total=n)
    return joined.select("b", "m").toDF("a", "b").union(least.toDF("a", "b")).where("a <> b")
