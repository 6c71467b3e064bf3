"""Fine-tuning that trains: Newton steps of a logistic operator on labelled rows, from the weights it has."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.models.operators import LinearOperator

RIDGE = 1e-6  # keeps a step bounded where features depend on each other or the labels are separable


@dataclass(frozen=True)
class Tuned:
    model: LinearOperator
    accuracy_before: float
    rows: int


def finetune(rows: DataFrame, model: LinearOperator, label: str, version: str, epochs: int = 5, frozen: tuple[str, ...] = ()) -> Tuned:
    """A new version of the model, fitted to label (0 or 1); weights of frozen features stay.

    Each epoch is one aggregate of the gradient and the curvature, numbers by the square of the features; rows with a NULL
    take no part, and without rows the weights stay.
    """
    if not model.logistic or not model.features:
        raise ValueError("fine-tuning takes a logistic operator with named features")
    names = list(model.features)
    data = rows.select(*(F.col(f"`{n}`").cast("float").cast("double").alias(f"x{i}") for i, n in enumerate(names)), F.col(f"`{label}`").cast("double").alias("y")).na.drop()
    inputs = [*(f"x{i}" for i in range(len(names))), "one"]
    free = [i for i, n in enumerate([*names, "one"]) if n not in frozen]
    weights, right, count = np.array([*model.weights, model.bias], np.float64), [], 0
    for _ in range(epochs + 1):
        z = F.lit(float(weights[-1]))
        for i, w in enumerate(weights[:-1]):
            z = z + F.lit(float(w)) * F.col(f"x{i}")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        scored = data.withColumns({"one": F.lit(1.0), "p": p})
        sums = [F.count(F.lit(1)).alias("n"), F.sum(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("long")).alias("right")]
        sums += [F.sum((F.col("y") - F.col("p")) * F.col(inputs[i])).alias(f"g{i}") for i in free]
        sums += [F.sum(F.col("p") * (1 - F.col("p")) * F.col(inputs[i]) * F.col(inputs[j])).alias(f"h{i}_{j}") for i in free for j in free if i <= j]
        told = scored.agg(*sums).first()
        count = told["n"]
        if not count:
            break
        right.append(told["right"] / count)
        if len(right) > epochs:
            break
        gradient = np.array([told[f"g{i}"] for i in free]) / count
        curve = np.array([[told[f"h{min(i, j)}_{max(i, j)}"] for j in free] for i in free]) / count
        scale = np.diag(np.maximum(np.diag(curve), RIDGE))
        weights[free] += np.linalg.solve(curve + RIDGE * np.eye(len(free)) + 1e-3 * scale, gradient)
    tuned = replace(model, weights=weights[:-1].tolist(), bias=float(weights[-1]), version=version, accuracy=right[-1] if right else model.accuracy)
    return Tuned(tuned, right[0] if right else 0.0, int(count))
