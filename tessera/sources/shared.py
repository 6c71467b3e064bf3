"""Written tables in the folder that all executors share; they cut lineage, so a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import EngineError

_OWN_DIR = "tessera.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset and one machine runs all."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise EngineError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set(_OWN_DIR, found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Store:
    """Written tables of one query. ``drop`` removes what no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, f"{self.path}/{name}")

    def keep(self, *names: str) -> None:
        """Remove all tables but these, once what was made of the others is written."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        for found in folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
            if found.getPath().getName() not in names:
                self.drop(found.getPath().getName())
