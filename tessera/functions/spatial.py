"""Points, boxes, point clouds and sound as structs and arrays, so columns are pruned and nothing is a blob."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _F, _L, _S = T.DoubleType(), T.FloatType(), T.LongType(), T.StringType()


def _fields(*pairs: tuple[str, T.DataType], optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n in optional) for n, t in pairs])


POINT = _fields(("x", _D), ("y", _D), ("z", _D))
BOX = _fields(*((f"{e}_{a}", _D) for e in ("min", "max") for a in "xyz"))
CLOUD = T.ArrayType(POINT, False)
EVENT = _fields(("label", _S), ("start", _D), ("end", _D), ("confidence", _D))
MEL = T.StructType([T.StructField("values", T.ArrayType(_D, False)), *(T.StructField(n, T.IntegerType()) for n in ("n_mels", "n_frames", "sample_rate", "hop_length"))])

_PROVENANCE = ("provenance", T.BinaryType())
#: Fixed schemas of scene graphs, entity graphs and the model catalog.
SCHEMAS: dict[str, T.StructType] = {
    "objects": _fields(
        ("object_id", _S), ("frame_id", _L), ("class_label", _S), ("confidence", _D), ("bbox_x_min", _F), ("bbox_y_min", _F), ("bbox_x_max", _F), ("bbox_y_max", _F),
        ("source_model_id", _S), ("source_model_ver", _S), _PROVENANCE, optional=("frame_id", "provenance")),
    "scene_relationships": _fields(("rel_id", _S), ("subject_id", _S), ("object_id", _S), ("predicate", _S), ("confidence", _D), ("frame_id", _L), _PROVENANCE, optional=("frame_id", "provenance")),
    "attributes": _fields(("object_id", _S), ("attribute_key", _S), ("attribute_value", _S), ("confidence", _D), _PROVENANCE, optional=("provenance",)),
    "entities": _fields(("entity_id", _S), ("entity_type", _S), ("canonical_name", _S), ("confidence", _D), ("source_model_id", _S), _PROVENANCE, optional=("provenance",)),
    "mentions": _fields(("mention_id", _S), ("entity_id", _S), ("doc_id", _S), ("span_start", _L), ("span_end", _L), ("surface_form", _S), _PROVENANCE, optional=("provenance",)),
    "text_relationships": _fields(("rel_id", _S), ("subject_entity_id", _S), ("object_entity_id", _S), ("predicate", _S), ("confidence", _D), ("doc_id", _S), _PROVENANCE, optional=("doc_id", "provenance")),
    "__ai_models": _fields(
        ("model_id", _S), ("name", _S), ("version", _S), ("format", _S), ("input_schema_json", _S), ("output_schema_json", _S), ("avg_latency_ms", _D), ("accuracy", _D), ("size_bytes", _L),
        ("device_affinity", _S), ("created_at", _S), ("updated_at", _S), optional=("input_schema_json", "output_schema_json", "device_affinity")),
}


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in "xyz"), F.lit(0.0)))


def box_volume(b: Column) -> Column:
    return F.abs(b["max_x"] - b["min_x"]) * F.abs(b["max_y"] - b["min_y"]) * F.abs(b["max_z"] - b["min_z"])


def box_center(b: Column) -> Column:
    return F.struct(*(((b[f"min_{k}"] + b[f"max_{k}"]) / 2).alias(k) for k in "xyz"))


def box_iou(a: Column, b: Column) -> Column:
    """Volume of the intersection over that of the union; 0 without an intersection."""
    shared = F.lit(1.0)
    for k in "xyz":
        shared = shared * F.greatest(F.least(a[f"max_{k}"], b[f"max_{k}"]) - F.greatest(a[f"min_{k}"], b[f"min_{k}"]), F.lit(0.0))
    return F.when(shared <= 0, F.lit(0.0)).otherwise(shared / (box_volume(a) + box_volume(b) - shared))


def centroid(cloud: Column) -> Column:
    """Mean point of an array of points; NULL if there is none."""
    mean = lambda k: F.aggregate(cloud, F.lit(0.0), lambda s, p: s + p[k]) / F.size(cloud)
    return F.when(F.size(cloud) > 0, F.struct(*(mean(k).alias(k) for k in "xyz")))


def mean_confidence(events: Column) -> Column:
    """Mean of the events' confidence, 0 without events."""
    return F.when(F.size(events) > 0, F.aggregate(events, F.lit(0.0), lambda s, e: s + e["confidence"]) / F.size(events)).otherwise(F.lit(0.0))


def events_in_window(events: Column, start: Column | float, end: Column | float) -> Column:
    """Events that begin at or after start and before end."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    return F.filter(events, lambda e: (e["start"] >= lo) & (e["start"] < hi))


def mel_value(mel: Column, band: Column | int, frame: Column | int) -> Column:
    """Value of a band and frame, row after row; NULL outside."""
    band, frame = (x if isinstance(x, Column) else F.lit(x) for x in (band, frame))
    inside = (band >= 0) & (frame >= 0) & (band < mel["n_mels"]) & (frame < mel["n_frames"])
    return F.when(inside, F.try_element_at(mel["values"], (band * mel["n_frames"] + frame + 1).cast("int")))


def mel_duration(mel: Column) -> Column:
    """Seconds of a spectrogram."""
    return mel["n_frames"].cast("double") * mel["hop_length"] / mel["sample_rate"]


def tempo(events: Column) -> Column:
    """Beats a minute from the mean distance of successive onsets; NULL with fewer than two events."""
    starts = F.array_sort(F.transform(events, lambda e: e["start"]))
    span = F.element_at(starts, -1) - F.element_at(starts, 1)
    return F.when((F.size(events) >= 2) & (span > 0), F.lit(60.0) * (F.size(events) - 1) / span)
