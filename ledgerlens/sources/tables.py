"""Tables in hash buckets, changed by commits: a change reads and writes the buckets of its keys only.

A table is a folder. ``data`` has a folder of Parquet for each change and bucket; ``commits`` has numbered lists of which folder
each bucket is in now. A change writes new folders first and its list last, under the next number, which it gets only if no other change has it. So readers
see a change as a whole or not at all, a failure before the list leaves the table as it was, and of two changes at once one raises ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new table: what a change of a few keys reads is their share of it.
BUCKETS = 256


class Conflict(RuntimeError):
    """Another change was committed since the table was read."""


@dataclass(frozen=True)
class Commit:
    """A state of the table: its number, and the folder of each bucket that has rows."""

    number: int
    folders: dict[int, str]
    #: Buckets that the change wrote, or emptied.
    touched: tuple[int, ...] = ()


class Table:
    """A table by its folder; ``keys`` say which bucket a row is in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        head = json.loads(self._text(f"{self.folder}/table.json"))
        self.schema, self.keys, self.buckets = StructType.fromJson(head["schema"]), head["keys"], head["buckets"]

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: list[str], buckets: int = BUCKETS) -> Table:
        """A new table of some rows, maybe none."""
        spark, folder = rows.sparkSession, folder.rstrip("/")
        made = object.__new__(cls)
        made.spark, made.folder, made.schema, made.keys, made.buckets = spark, folder, rows.schema, keys, buckets
        made._put(f"{folder}/table.json", json.dumps({"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets}))
        folders = made._write(rows)
        made._commit(Commit(0, folders, tuple(folders)))
        return made

    # Files

    def _at(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _text(self, path: str) -> str:
        files, at = self._at(path)
        stream = files.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Writes a file beside its place and moves it there, unless that is taken."""
        files, at = self._at(path)
        _, beside = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = files.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if files.exists(at) or not files.rename(beside, at):
            files.delete(beside, False)
            raise Conflict(path)

    # States

    def numbers(self) -> list[int]:
        files, at = self._at(f"{self.folder}/commits")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def state(self, number: int | None = None) -> Commit:
        """The latest state, or that of a number."""
        number = max(self.numbers()) if number is None else number
        said = json.loads(self._text(f"{self.folder}/commits/{number}.json"))
        return Commit(number, {int(k): v for k, v in said["folders"].items()}, tuple(said["touched"]))

    def _commit(self, commit: Commit) -> None:
        files, at = self._at(f"{self.folder}/commits")
        files.mkdirs(at)
        self._put(f"{self.folder}/commits/{commit.number}.json", json.dumps({"folders": commit.folders, "touched": commit.touched}))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the latest state, or of an older one that hasn't been cleaned away."""
        return self._rows(list(self.state(number).folders.values()))

    def bucket(self) -> Column:
        """A row's bucket."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, out of their buckets."""
        state = self.state()
        mine = [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # no more than there are buckets
        return self._rows([state.folders[b] for b in mine if b in state.folders]).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    # Changes

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Writes rows by bucket into a folder of their own, and says where each bucket is."""
        own = f"data/{uuid.uuid4().hex}"
        columns = [f.name for f in self.schema]
        typed = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        typed.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{own}")
        assert "_bucket" not in columns
        files, at = self._at(f"{self.folder}/{own}")
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return {int(n.split("=")[1]): f"{own}/{n}" for n in names if n.startswith("_bucket=")}

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Commit:
        """Changes the buckets of the keys of ``rows`` to what ``merge(old, rows)`` gives, where ``old`` are all rows of these buckets. Other buckets aren't read.

        ``merge`` must leave rows in their buckets. No rows, no change.
        """
        state = self.state()
        touched = sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())  # no more than there are buckets
        if not touched:
            return state
        old = self._rows([state.folders[b] for b in touched if b in state.folders])
        written = self._write(merge(old, rows))
        if stray := set(written) - set(touched):
            raise ValueError(f"rows have left their buckets for {sorted(stray)}")
        kept = {b: f for b, f in state.folders.items() if b not in set(touched)}
        commit = Commit(state.number + 1, kept | written, tuple(touched))
        self._commit(commit)
        return commit

    def upsert(self, rows: DataFrame, order: str | None = None) -> Commit:
        """Rows by key, over those there; of several of a key, the last by ``order``."""
        from ledgerlens.operators.load import upsert

        return self.change(rows, lambda old, new: upsert(old, new, self.keys, order))

    def replace(self, rows: DataFrame) -> Commit:
        """All rows of the keys of ``rows`` go, and ``rows`` come."""
        from ledgerlens.operators.load import replaced

        if len(self.keys) != 1:
            raise ValueError("rows are replaced by a single key")
        return self.change(rows, lambda old, new: replaced(old, new, self.keys[0]))

    def delete(self, keys: DataFrame) -> Commit:
        """The rows of some keys go."""
        return self.change(keys.select(*self.keys), lambda old, gone: old.join(gone.distinct(), self.keys, "left_anti"))

    def clean(self, keep: int = 1) -> int:
        """Deletes folders that none of the last ``keep`` states has, and older states; how many folders. For when no older state is being read, and no change is being made."""
        numbers = self.numbers()
        used = {f for n in numbers[-keep:] for f in self.state(n).folders.values()}
        files, at = self._at(f"{self.folder}/data")
        gone = 0
        for change in files.listStatus(at) if files.exists(at) else []:
            for part in files.listStatus(change.getPath()):
                name = f"data/{change.getPath().getName()}/{part.getPath().getName()}"
                if "_bucket=" in name and name not in used:
                    files.delete(part.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            files.delete(self._at(f"{self.folder}/commits/{n}.json")[1], False)
        return gone
