"""Models that score rows. A native operator is a Column expression; an ONNX operator runs in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ModelNotFound

NUMERIC = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)


@runtime_checkable
class Operator(Protocol):
    """What the planner and SQL need of a model."""

    function_id: str
    version: str
    latency_ms: float
    accuracy: float
    features: list[str] | None

    def score(self, columns: list[Column]) -> Column: ...


@dataclass
class LinearOperator:
    """weights · features + bias, through a logistic curve if so asked. Inputs are read as 32-bit floats, as models do."""

    function_id: str
    weights: list[float]
    bias: float = 0.0
    logistic: bool = True
    version: str = "1.0.0"
    latency_ms: float = 1.0
    accuracy: float = 0.95
    features: list[str] | None = None
    device_affinity: str | None = None
    format: str = field(default="native", repr=False)

    def score(self, columns: list[Column]) -> Column:
        if len(columns) != len(self.weights):
            raise ValueError(f"{self.function_id} takes {len(self.weights)} numbers, not {len(columns)}")
        total = F.lit(float(self.bias))
        for w, c in zip(self.weights, columns, strict=True):
            total = total + F.lit(float(w)) * c.cast("float").cast("double")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if self.logistic else total

    def predict(self, rows: np.ndarray) -> np.ndarray:
        z = rows.astype(np.float32).astype(np.float64) @ np.array(self.weights) + self.bias
        return 1 / (1 + np.exp(-z)) if self.logistic else z


_sessions: dict[int, object] = {}


def _session(content: bytes):
    """One inference session for each model and Python worker."""
    import onnxruntime

    key = hash(content)
    if key not in _sessions:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks are the parallelism
        _sessions[key] = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
    return _sessions[key]


def run_onnx(content: bytes, rows: np.ndarray) -> np.ndarray:
    """First output, first value of each row, as doubles. Rows are fed row after row."""
    session = _session(content)
    out = session.run(None, {session.get_inputs()[0].name: np.ascontiguousarray(rows, dtype=np.float32)})[0]
    return np.asarray(out, dtype=np.float64).reshape(len(rows), -1)[:, 0] if len(rows) else np.zeros(0)


def onnx_inputs(content: bytes) -> int:
    """How many numbers a row of the model's input has."""
    return int(_session(content).get_inputs()[0].shape[-1])


def onnx_udf(content: bytes):
    """An Arrow UDF from an array of inputs to the score; a NULL input is read as NaN."""

    @F.pandas_udf("double")
    def infer(values: pd.Series) -> pd.Series:
        rows = np.stack([np.array(v, dtype=np.float32) for v in values]) if len(values) else np.zeros((0, 1), np.float32)
        return pd.Series(run_onnx(content, rows))

    return infer


@dataclass
class OnnxOperator:
    """A model file, read once on the driver and sent with the plan; each Python worker keeps one session."""

    function_id: str
    content: bytes = field(repr=False, default=b"")
    version: str = "1.0.0"
    latency_ms: float = 1.0
    accuracy: float = 0.95
    features: list[str] | None = None
    device_affinity: str | None = None
    format: str = field(default="onnx", repr=False)

    @classmethod
    def from_file(cls, function_id: str, path: str, **options) -> OnnxOperator:
        with open(path, "rb") as f:
            return cls(function_id, f.read(), **options)

    def score(self, columns: list[Column]) -> Column:
        return onnx_udf(self.content)(F.array(*(c.cast("float") for c in columns)))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _wire(number: int, value: int | bytes | str) -> bytes:
    """A field of a protocol buffer: an integer, or a length and bytes."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def export_onnx(operator: LinearOperator) -> bytes:
    """A native model as the bytes of a model file: rows times weights, plus bias, and the sigmoid if it is logistic."""
    n, last = len(operator.weights), "y" if operator.logistic else "z"

    def node(kind: str, inputs: tuple[str, ...], output: str) -> bytes:
        return _wire(1, b"".join(_wire(1, i) for i in inputs) + _wire(2, output) + _wire(4, kind))

    def constant(name: str, shape: tuple[int, ...], values: list[float]) -> bytes:
        return _wire(5, b"".join(_wire(1, d) for d in shape) + _wire(2, 1) + _wire(8, name) + _wire(9, np.asarray(values, "<f4").tobytes()))

    def matrix(name: str, width: int) -> bytes:
        shape = _wire(1, _wire(2, "rows")) + _wire(1, _wire(1, width))
        return _wire(1, name) + _wire(2, _wire(1, _wire(1, 1) + _wire(2, shape)))

    graph = node("MatMul", ("x", "weights"), "products") + node("Add", ("products", "bias"), "z") + (node("Sigmoid", ("z",), "y") if operator.logistic else b"")
    graph += _wire(2, operator.function_id) + constant("weights", (n, 1), operator.weights) + constant("bias", (1,), [operator.bias])
    graph += _wire(11, matrix("x", n)) + _wire(12, matrix(last, 1))
    return _wire(1, 8) + _wire(7, graph) + _wire(8, _wire(1, "") + _wire(2, 13))


def model_features(operator: Operator, frame: DataFrame) -> list[str]:
    """The operator's own feature columns, or else all float and double columns in schema order."""
    if operator.features:
        return operator.features
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def checked_arguments(frame: DataFrame, names: list[str]) -> list[Column]:
    """Columns of a numeric type a model takes; at least one."""
    if not names:
        raise ValueError("a model needs at least one number")
    for n in names:
        kind = frame.schema[n].dataType
        if not isinstance(kind, NUMERIC):
            raise ValueError(f"column {n} of type {kind.simpleString()} is no model input")
    return [F.col(f"`{n}`") for n in names]


def predict(frame: DataFrame, operator: Operator, column: str, kind: str = "value", threshold: float = 0.5) -> DataFrame:
    """All columns and the prediction: the score, or the class (score >= threshold) as a long."""
    score = operator.score(checked_arguments(frame, model_features(operator, frame)))
    return frame.withColumn(column, score if kind.lower() == "value" else (score >= threshold).cast("long"))


def neural_scan(frame: DataFrame, operator: Operator) -> DataFrame:
    """The model's output in place of the rows."""
    return frame.select(operator.score(checked_arguments(frame, model_features(operator, frame))).alias("score"))


def version_key(version: str) -> tuple:
    """Order of versions by number, so 10.0.0 is later than 9.0.0; text parts come before numbers."""
    return tuple((1, int(p), "") if p.isdigit() else (0, 0, p) for p in version.replace("-", ".").split("."))


class Registry:
    """Operators by function and version, and the catalog of models they come from."""

    def __init__(self):
        self.models: dict[str, dict] = {}
        self.operators: dict[tuple[str, str], Operator] = {}
        self.owner: dict[tuple[str, str], str] = {}

    def register(self, operator: Operator, model_id: str, created: str = "", size: int = 0) -> str:
        key = (operator.function_id, operator.version)
        self.operators[key], self.owner[key] = operator, model_id
        self.models[model_id] = {
            "model_id": model_id, "name": operator.function_id, "version": operator.version, "format": getattr(operator, "format", "native"),
            "input_schema_json": None, "output_schema_json": None, "avg_latency_ms": float(operator.latency_ms), "accuracy": float(operator.accuracy),
            "size_bytes": int(size), "device_affinity": getattr(operator, "device_affinity", None), "created_at": created, "updated_at": created,
        }
        return model_id

    def unregister(self, model_id: str) -> None:
        self.models.pop(model_id, None)
        for key in [k for k, m in self.owner.items() if m == model_id]:
            del self.owner[key], self.operators[key]

    def latest(self, function_id: str) -> Operator:
        found = self.variants(function_id)
        if not found:
            raise ModelNotFound(function_id)
        return max(found, key=lambda o: version_key(o.version))

    def variants(self, function_id: str) -> list[Operator]:
        return [o for (f, _), o in self.operators.items() if f == function_id]
