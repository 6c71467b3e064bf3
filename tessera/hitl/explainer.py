"""What a query did: a summary from one aggregate, and bounded details of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import provenance as prov

SCORES = ("fraud_prob", "confidence", "score")
DETAIL_ROWS = 100
BRACKET = 2000  # accuracy of the sketch that brackets a median: one part in so many


@dataclass
class Explanation:
    summary: str
    rows: list[str] = field(default_factory=list)


def exact_median(frame: DataFrame, column: str, rows: int) -> float | None:
    """The median of the rows values that are there, without holding them: a quantile sketch brackets the middle, and the
    bracket, some thousandths of the values, is counted by value and walked in order (ties are one row)."""
    if not rows:
        return None
    c = F.col(f"`{column}`").cast("double")
    values = frame.filter(c.isNotNull()).select(c.alias("x"))
    lo, hi = (rows - 1) // 2, rows // 2  # places of the one or two middle values
    share = [max(0.0, 0.5 - 2 / BRACKET), min(1.0, 0.5 + 2 / BRACKET)]
    left, right = values.agg(F.percentile_approx("x", share, BRACKET).alias("q")).first()["q"]
    inside = values.filter(F.col("x").between(left, right)).groupBy("x").agg(F.count("*").alias("n"))
    before = values.filter(F.col("x") < left).count()
    order = Window.orderBy("x")
    placed = inside.withColumn("end", F.sum("n").over(order) + before)
    middle = lambda at: F.min(F.when(F.col("end") > at, F.col("x")))
    row = placed.agg(middle(lo).alias("a"), middle(hi).alias("b")).first()
    return (row["a"] + row["b"]) / 2


def score_stats(frame: DataFrame, column: str) -> DataFrame:
    """min, max, mean and exact median of the values that are there; zeros if none is."""
    c = F.col(f"`{column}`")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    median = exact_median(frame, column, frame.select(c).agg(F.count(c).alias("n")).first()["n"])
    return frame.agg(zero(F.min(c)).alias("min"), zero(F.max(c)).alias("max"), zero(F.avg(c)).alias("mean")).withColumn("median", F.lit(median or 0.0))


def explain(frame: DataFrame, rules: dict[str, str], models: list[tuple[str, str]], mode: str, level: str = "coarse", device: str = "", limit: int = DETAIL_ROWS) -> Explanation:
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    scores = [c for c in SCORES if isinstance(kinds.get(c), T.DoubleType)]
    wanted = [F.count(F.lit(1)).alias("n")]
    for c in scores:
        col = F.col(f"`{c}`")
        wanted += [f(col).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("known", F.count))]
    values = frame.agg(*wanted).first().asDict()
    values |= {f"median_{c}": exact_median(frame, c, values[f"known_{c}"]) for c in scores}
    out = ["Pipeline summary", f"  Produced {values['n']} row(s)", f"  Provenance: {mode}", f"  Schema: [{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in frame.schema.fields)}]"]
    for c in scores:
        out.append(f"  Score distribution ({c}): " + ", ".join(f"{n}={values[f'{n}_{c}'] or 0.0:.4f}" for n in ("min", "max", "mean", "median")))
    if rules:
        out += ["Rules applied", *(f"  {name} <- {body}" for name, body in rules.items())]
    if models:
        out += ["Models used", *(f"  {name} v{version}" for name, version in models)]
    if device:
        out += ["Hardware", f"  {device}"]
    return Explanation("\n".join(out), reasoning(frame, mode, limit) if level == "fine" else [])


def reasoning(frame: DataFrame, mode: str, limit: int = DETAIL_ROWS) -> list[str]:
    """Provenance of the first rows as text; never more than limit rows come to the driver. Nothing in boolean mode."""
    if mode == "boolean" or "provenance" not in frame.columns:
        return []
    return told([r["provenance"] for r in frame.select("provenance").limit(limit).collect()], mode)


def told(values: list[bytes | None], mode: str) -> list[str]:
    """Provenance of rows as text; nothing in boolean mode."""
    out = []
    for i, value in enumerate(values if mode != "boolean" else ()):
        poly = prov.decode(value)
        out.append(f"row {i}: {prov.describe(poly) if poly is not None else f'<raw {len(value or b"")} bytes>'}")
    return out
