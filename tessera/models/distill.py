"""Distillation that trains: a logistic student fitted to a teacher's scores on the rows themselves, then measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models.operators import LinearOperator, Operator, checked_arguments


@dataclass(frozen=True)
class Distilled:
    student: LinearOperator
    agreement: float  # share of rows where student and teacher choose the same class
    rows: int


def distill(rows: DataFrame, teacher: Operator, name: str, features: list[str], temperature: float = 1.0, epochs: int = 50, latency_ms: float = 0.1) -> Distilled:
    """Each row counts once for each class, weighted by the teacher's softened probability of it."""
    scored = rows.select(*(F.col(f"`{f}`").cast("float").cast("double").alias(f) for f in features), teacher.score(checked_arguments(rows, teacher.features or features)).alias("_p")).na.drop()
    soft = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(F.greatest(F.col("_p"), F.lit(1e-9)) / F.greatest(F.lit(1.0) - F.col("_p"), F.lit(1e-9))) / temperature)))
    both = scored.withColumn("_s", soft).select(*features, F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("_s").alias("w")), F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - F.col("_s")).alias("w")))).alias("_l"))
    data = VectorAssembler(inputCols=features, outputCol="x").transform(both.select(*features, F.col("_l.y").alias("y"), F.col("_l.w").alias("w")))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=epochs).fit(data)
    student = LinearOperator(name, [float(c) for c in model.coefficients], float(model.intercept), features=list(features), latency_ms=latency_ms)
    same = (student.score([F.col(f) for f in features]) >= 0.5) == (F.col("_p") >= 0.5)
    told = scored.agg(F.avg(same.cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    student.accuracy = float(told["a"] or 0.0) * teacher.accuracy
    return Distilled(student, float(told["a"] or 0.0), int(told["n"]))
