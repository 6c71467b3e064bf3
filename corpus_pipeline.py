"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard import jaccard_groups
from tessera.llm.packing import pack_documents
from tessera.llm.quality import fit, well_scored
from tessera.llm.secrets import scan_secrets
from tessera.llm.store import Store, prepare, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    prepare(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return well_scored(spark, docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles of Jaccard 0.8 or more the one of the smallest doc_id stays."""
    found = jaccard_groups(spark, docs, k=5, num=80, den=100)
    return without(docs, "doc_id", found.filter("doc_id <> component_id").select("doc_id"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("spans") == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    masked = scan_secrets(spark, docs, mask=True)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: a row for each piece of a document."""
    return pack_documents(spark, docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("packing", packing),
]
ORACLE_SQL = None  # neither the classifier nor the packing is expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
