"""A fiber's overall direction, and its ends inside a box."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamenta.operators import segments as sg

PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def fiber_axes(vertices: DataFrame) -> DataFrame:
    """(fiber_id, ax, ay, az): the leading axis of a fiber's length-weighted tangent tensor, its largest component positive.

    A fiber without length has the axis x. The tensors are sums by fiber; their axes are found a batch at a time.
    """
    s = sg.segments(vertices).where("len > 0")
    sums = s.groupBy("fiber_id").agg(*[F.sum((F.col(f"{p[0]}2") - F.col(p[0])) * (F.col(f"{p[1]}2") - F.col(p[1])) / F.col("len")).alias(p) for p in PAIRS])
    every = vertices.select("fiber_id").distinct().join(sums, "fiber_id", "left").select("fiber_id", *[F.coalesce(p, F.lit(0.0)).alias(p) for p in PAIRS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = {p: batch.column(1 + k).to_numpy(zero_copy_only=False) for k, p in enumerate(PAIRS)}
            tensor = np.stack([np.stack([h[min(a, b) + max(a, b)] for b in "xyz"], -1) for a in "xyz"], -2)
            axis = np.linalg.eigh(tensor)[1][..., -1] if batch.num_rows else np.zeros((0, 3))
            top = np.take_along_axis(axis, np.argmax(np.round(np.abs(axis), 9), axis=1)[:, None], axis=1)
            axis = np.where((h["xx"] + h["yy"] + h["zz"] > 0)[:, None], axis * np.sign(top), [1.0, 0.0, 0.0])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(axis[:, k]) for k in range(3)]], ["fiber_id", "ax", "ay", "az"])

    kind = vertices.schema["fiber_id"].dataType.simpleString()
    return every.mapInArrow(run, f"fiber_id {kind}, ax double, ay double, az double")


def interior_ends(vertices: DataFrame, radii: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], margin: float = 1.5) -> DataFrame:
    """(fiber_id, start, stop): whether a fiber's first and last vertex lie ``margin`` radii or more inside the box."""
    w = Window.partitionBy("fiber_id")
    tips = vertices.withColumns({"first": F.col("seq") == F.min("seq").over(w), "last": F.col("seq") == F.max("seq").over(w)}).where("first or last").join(radii.select("fiber_id", "radius"), "fiber_id")
    inside = F.lit(True)
    for c, lo, hi in zip("xyz", low, high, strict=True):
        inside &= (F.col(c) >= lo + margin * F.col("radius")) & (F.col(c) <= hi - margin * F.col("radius"))
    return tips.groupBy("fiber_id").agg(F.bool_or(F.when(F.col("first"), inside)).alias("start"), F.bool_or(F.when(F.col("last"), inside)).alias("stop"))
