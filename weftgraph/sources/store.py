"""The tables of a crawl in one folder, changed by whole commits.

`versions/N.json` names the files of every table at version N; the greatest N is the present, and a folder without versions is
version 0, in which all tables are empty. A change stages new Parquet files beside the old ones and publishes them by one rename of
its version file, which never replaces one that is there. So a reader sees a version whole or not at all and keeps what it has read
from, a writer that dies before the rename leaves nothing but files that no version names, and of two changes to
one version the second is refused. Files are never rewritten in place: what changes is in new files, all others keep their names.

Which rows a change touches is found by joins; only the names of touched files reach the driver. A version file names
each file of each table and grows with their number. The file system has to rename without replacing (HDFS and local ones do).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.sources.tables import SCHEMAS, completed, schema
from weftgraph.storage import drop, durable, releasing

VERSIONS = "versions"


class Conflict(RuntimeError):
    """Another change was published after the version that this one was made from."""


class Folder:
    """Files below one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._hadoop_io = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        path = self._hadoop.Path(f"{self.path}/{name}" if name else self.path)
        return path if path.toUri().getScheme() else path.getFileSystem(self._conf).makeQualified(path)

    def below(self) -> str:
        """What stands before the names of the folder's files in their paths, without scheme and host."""
        return self._at("").toUri().getPath().rstrip("/") + "/"

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a file with this text appear at once; False if there is one of this name."""
        staged = f"{name.rpartition('/')[0]}/.staged-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._at("").toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)  # no leave to replace
        try:
            context.rename(self._at(staged), self._at(name), none)
        except Py4JJavaError as error:
            self.remove(staged)
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def append_all(self, names: list[str], target: str) -> None:
        """The files' bytes, one after the other, as a new file anywhere on this file system; it appears when it is whole."""
        there = self._hadoop.Path(target)
        staged = self._hadoop.Path(f"{target}.staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        for name in names:
            stream = self._fs.open(self._at(name))
            self._hadoop_io.copyBytes(stream, out, self._conf, False)
            stream.close()
        out.close()
        if not self._fs.rename(staged, there):
            raise FileExistsError(target)

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Snapshot:
    """One version of a store; what it reads stays the same whatever is published later."""

    def __init__(self, folder: Folder, version: int, tables: dict[str, list[str]]):
        self.folder, self.version, self._tables = folder, version, tables

    def files(self, name: str) -> list[str]:
        return list(self._tables.get(name, ()))

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.files(name))

    def _read(self, name: str, files: list[str]) -> DataFrame:
        spark, kind = self.folder.spark, schema(name)
        if not files:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*(f"{self.folder.path}/{f}" for f in files))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names(VERSIONS) if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The present, or an older version."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Snapshot(self.folder, 0, {})
        if version not in known:
            raise ValueError(f"there is no version {version}")
        return Snapshot(self.folder, version, json.loads(self.folder.read(_file_of(version)))["tables"])

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def change(self) -> Change:
        return Change(self.snapshot())

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the last `keep` versions, and every file that none of these names; how many files went.

        Not while another change is being made: its staged files are not named yet."""
        known = self.versions()
        held = {f for v in known[-keep:] for files in self.snapshot(v)._tables.values() for f in files}
        for v in known[:-keep]:
            self.folder.remove(_file_of(v))
        gone = 0
        for name in SCHEMAS:
            for part in self.folder.names(name):
                at = f"{name}/{part}"
                mine = [f"{at}/{f}" for f in self.folder.names(at) if f.endswith(".parquet")]
                lost = [f for f in mine if f not in held]
                gone += len(lost)
                for f in [at] if len(lost) == len(mine) else lost:
                    self.folder.remove(f)
        return gone


def _file_of(version: int) -> str:
    return f"{VERSIONS}/{version:012d}.json"


class Change(Snapshot):
    """A snapshot with staged changes, which its own reads see and others don't before publish()."""

    def __init__(self, base: Snapshot):
        super().__init__(base.folder, base.version, {name: base.files(name) for name in base._tables})

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table anew."""
        self._tables[name] = self._stage(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        self._tables[name] = self.files(name) + self._stage(name, rows)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """rows, which hold each key once, in place of the rows with their keys."""
        rows = durable(completed(rows, name), f"store-{name}")
        self.exchange(name, rows.select(keys), keys, rows)
        drop(rows)

    def merge(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """The same, but rows that are in the table as they are touch no file."""
        self.upsert(name, changed_rows(self.table(name), completed(rows, name), keys), keys)

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        self.exchange(name, gone.select(keys), keys, None)

    def exchange(self, name: str, gone: DataFrame, keys: list[str], rows: DataFrame | None, only: Column | None = None) -> None:
        """Remove the rows whose keys are in gone and of which `only` holds, then add rows; files that hold none of the removed stay."""
        old = self.table(name)
        gone = durable(gone.distinct().withColumn("__gone", F.lit(True)), f"store-{name}")
        only = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        touched: list[str] = []
        if self.files(name) and not gone.isEmpty():
            hit = old.filter(only).select(*keys, F.col("_metadata.file_path").alias("__file")).join(gone, keys, "left_semi")
            tails = {r[0].rpartition("/")[2]: None for r in hit.select("__file").distinct().collect()}  # staged names are unique
            touched = [f for f in self.files(name) if f.rpartition("/")[2] in tails]
        staged = []
        if touched:
            held = self._read(name, touched)
            kept = held.join(gone, keys, "left").filter(~(F.coalesce("__gone", F.lit(False)) & only)).select(held.columns)
            staged = self._stage(name, kept if rows is None else kept.unionByName(completed(rows, name)))
        elif rows is not None and not rows.isEmpty():
            staged = self._stage(name, rows)
        self._tables[name] = [f for f in self.files(name) if f not in set(touched)] + staged

    def _stage(self, name: str, rows: DataFrame) -> list[str]:
        part = f"{name}/{uuid.uuid4().hex}"
        with releasing(self.folder.spark):
            completed(rows, name).write.option("compression", "zstd").parquet(f"{self.folder.path}/{part}")
        return [f"{part}/{f}" for f in self.folder.names(part) if f.endswith(".parquet")]

    def publish(self, note: str = "") -> int:
        """Make the change the present; the new version's number. Raises Conflict if another change was faster."""
        version = self.version + 1
        text = json.dumps({"version": version, "note": note, "tables": self._tables})
        if not self.folder.publish(_file_of(version), text):
            raise Conflict(f"version {version} was published by another change")
        self.version = version
        return version


def row_digest(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}))


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new that old lacks or has with other values, told by digests: of old, keys and a digest of each row are shuffled."""
    columns = [c for c in new.columns if c not in keys]
    mine = new.withColumn("__digest", row_digest(columns))
    return mine.join(old.select(*keys, row_digest(columns).alias("__digest")), [*keys, "__digest"], "left_anti").drop("__digest")
