"""Files to tables, and results to sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.errors import TableError

INFER_ROWS = 100  # rows that decide the types of a CSV file


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def infer_csv_schema(spark: SparkSession, path: str, rows: int = INFER_ROWS) -> T.StructType:
    """Types by the header and the first rows of the file; the whole file is not read for it."""
    head = [r["value"] for r in spark.read.text(path).limit(rows + 1).collect()]
    if not head:
        raise TableError(f"{path} is empty")
    found = spark.read.csv(spark.sparkContext.parallelize(head, 1), header=True, inferSchema=True).schema
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType, True) for f in found.fields])


def ingest_csv(spark: SparkSession, path: str, out: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with header to Parquet at out, which must not exist. Fails if the file has no rows."""
    if path_exists(spark, out):
        raise TableError(f"{out} exists")
    frame = spark.read.schema(schema or infer_csv_schema(spark, path)).csv(path, header=True, enforceSchema=True)
    if frame.limit(1).isEmpty():
        raise TableError(f"{path} has no rows")
    frame.write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def ingest_frame(frame: DataFrame, out: str, mode: str = "errorifexists") -> DataFrame:
    frame.write.mode(mode).parquet(out)
    return frame.sparkSession.read.parquet(out)


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Parquet, JSON, ORC or CSV by kind or by the ending of the path (any file system Spark reads)."""
    kind = kind or next((k for k in ("json", "orc", "csv") if path.rstrip("/").endswith(k)), "parquet")
    if kind == "csv":
        return spark.read.schema(infer_csv_schema(spark, path)).csv(path, header=True)
    return spark.read.format(kind).load(path)


def arrow_stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def to_arrow_stream(frame: DataFrame) -> bytes:
    """The result as an Arrow IPC stream, for clients; a sink for results that fit a client."""
    return arrow_stream(frame.toArrow())


def from_arrow_stream(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def pretty(frame: DataFrame, rows: int = 20) -> str:
    """A bounded table of text and how many rows it shows."""
    head = frame.limit(rows).toPandas()
    return f"{head.to_string(index=False)}\n{len(head)} row(s)"
