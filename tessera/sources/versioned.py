"""Versioned tables of Parquet files.

``_versions/<n>.json`` lists the files of version n. Writers add files under a folder of their own and commit by creating the
next list, which fails if another writer was first (optimistic concurrency); nothing that a version lists is ever
changed, so any version can be read. Deletes, updates and merges rewrite only the files that hold a row they change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import TableError, VersionConflict


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_versions/{version:010d}.json"

    @property
    def version(self) -> int:
        """The latest version, 0 if there is none."""
        folder = self._path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=0)

    def _load(self, version: int) -> dict:
        name = self._path(self._manifest(version))
        if not self._fs.exists(name):
            raise TableError(f"{self.path} has no version {version}")
        stream = self._fs.open(name)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int, files: list[str], schema: T.StructType) -> int:
        """Create the list of base + 1; fails if it is there."""
        name = self._path(self._manifest(base + 1))
        data = json.dumps({"version": base + 1, "files": sorted(files), "schema": schema.jsonValue()}).encode()
        try:
            stream = self._fs.create(name, False)
        except Exception as e:
            raise VersionConflict(f"version {base + 1} of {self.path} was committed by another writer") from e
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return base + 1

    def _write(self, frame: DataFrame) -> list[str]:
        """New files, relative to the table."""
        folder = f"data/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{folder}")
        return [f"{folder}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet")]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named; an empty version keeps its schema."""
        found = self._load(version or self.version)
        schema = T.StructType.fromJson(found["schema"])
        if not found["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in found["files"]))

    def _counted(self, frame: DataFrame) -> tuple[list[str], int]:
        seen = Observation()
        files = self._write(frame.observe(seen, F.count(F.lit(1)).alias("n")))
        return files, int(seen.get["n"])

    def create(self, frame: DataFrame) -> int:
        if self.version:
            raise TableError(f"{self.path} exists")
        return self._commit(0, self._write(frame), frame.schema)

    def insert(self, frame: DataFrame) -> tuple[int, int]:
        """(rows added, new version). Rows must have the table's columns; no rows is an error."""
        base = self.version
        if not base:
            files, rows = self._counted(frame)
            if not rows:
                raise TableError("nothing to insert")
            return rows, self._commit(0, files, frame.schema)
        old = self._load(base)
        schema = T.StructType.fromJson(old["schema"])
        if sorted(frame.columns) != sorted(schema.names):
            raise TableError(f"columns {frame.columns} are not those of the table, {schema.names}")
        files, rows = self._counted(frame.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields)))
        if not rows:
            raise TableError("nothing to insert")
        return rows, self._commit(base, old["files"] + files, schema)

    def delete(self, predicate: str) -> tuple[int, int]:
        """(rows deleted, version). NULL is not true, so such rows stay. Without a hit there is no new version."""
        base = self.version
        old = self._load(base)
        if not old["files"]:
            return 0, base
        schema = T.StructType.fromJson(old["schema"])
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        names, rows = self._touched(old, self._placed(base).filter(hit))
        if not names:
            return 0, base
        files = self._write(self._files(names, schema).filter(~hit))
        return rows, self._commit(base, [f for f in old["files"] if f not in names] + files, schema)

    def _touched(self, listed: dict, rows: DataFrame) -> tuple[set[str], int]:
        """The listed files that rows of the table stand in, and how many rows they are."""
        found = rows.groupBy(F.col("_file").alias("f")).agg(F.count("*").alias("n")).collect()  # a row for each file touched
        ends = {"/".join(r["f"].split("/")[-3:]) for r in found}
        return {f for f in listed["files"] if f in ends}, sum(r["n"] for r in found)

    def _placed(self, version: int) -> DataFrame:
        return self.read(version).select("*", F.col("_metadata.file_path").alias("_file"))

    def _files(self, names: set[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in sorted(names)))

    def update(self, assignments: dict[str, str], predicate: str) -> tuple[int, int]:
        """(rows changed, version): columns set to SQL expressions where the predicate is true. Without a hit there is no new version."""
        base = self.version
        old = self._load(base)
        schema = T.StructType.fromJson(old["schema"])
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        names, rows = self._touched(old, self._placed(base).filter(hit)) if old["files"] else (set(), 0)
        if not names:
            return 0, base
        value = lambda f: F.when(hit, F.expr(assignments[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in assignments else F.col(f.name)
        files = self._write(self._files(names, schema).select(*map(value, schema.fields)))
        return rows, self._commit(base, [f for f in old["files"] if f not in names] + files, schema)

    def merge(self, rows: DataFrame, keys: list[str]) -> int:
        """Upsert by key: rows replace the table's rows of equal keys, others are added. A key that repeats in rows is an error, as it
        would not tell which row stands; a NULL key equals none and is added."""
        base = self.version
        old = self._load(base)
        schema = T.StructType.fromJson(old["schema"])
        if not rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():
            raise TableError(f"rows to merge repeat a key {keys}")
        added = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
        wanted = added.select(*keys)
        names, _ = self._touched(old, self._placed(base).join(wanted, keys, "left_semi")) if old["files"] else (set(), 0)
        files = self._write(added)
        if names:
            files += self._write(self._files(names, schema).join(wanted, keys, "left_anti").select(*schema.names))
        return self._commit(base, [f for f in old["files"] if f not in names] + files, schema)

    def overwrite(self, frame: DataFrame) -> int:
        return self._commit(self.version, self._write(frame), frame.schema)


def open_cached(spark: SparkSession, path: str) -> DataFrame:
    """An eager copy of the table in executor memory (spilling to disk); an empty one keeps its schema."""
    frame = spark.read.parquet(path).cache()
    frame.count()
    return frame
