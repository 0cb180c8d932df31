"""Lengths, volumes and orientation of fiber assemblies, per fiber, per material and in total."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg

AXES = ("xx", "yy", "zz", "xy", "xz", "yz")


def fiber_lengths(v: DataFrame) -> DataFrame:
    """(fiber_id, vertices, segments, length, end_to_end, straightness): straightness 0 without length."""
    w = sg.along()
    s = v.withColumns({f"{c}2": F.lead(c).over(w) for c in "xyz"})
    d = g.norm(g.sub(g.vec(suffix="2"), g.vec()))
    ends = s.groupBy("fiber_id").agg(
        F.count("*").alias("vertices"),
        F.count("x2").alias("segments"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("length"),
        *[F.min_by(c, "seq").alias(f"{c}0") for c in "xyz"],
        *[F.max_by(c, "seq").alias(f"{c}1") for c in "xyz"],
    )
    e = g.norm(g.sub(g.vec(suffix="1"), g.vec(suffix="0")))
    return ends.select("fiber_id", "vertices", "segments", "length", e.alias("end_to_end"), F.coalesce(g.ratio(e, F.col("length")), F.lit(0.0)).alias("straightness"))


def _tensor(weight: Column) -> list[Column]:
    return [F.sum(weight * F.col(f"t{a[0]}") * F.col(f"t{a[1]}")).alias(a) for a in AXES]


def orientation(v: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Length-weighted orientation tensor by ``keys``: six distinct components, divided by the weight."""
    t = sg.tangents(sg.segments(v))
    out = t.groupBy(*(keys or [])).agg(F.sum("len").alias("weight"), *_tensor(F.col("len")))
    return out.select(*(keys or []), "weight", *[F.coalesce(g.ratio(F.col(a), F.col("weight")), F.lit(0.0)).alias(a) for a in AXES])


def assembly_metrics(v: DataFrame, fibers: DataFrame, materials: DataFrame, cell_volume: float) -> DataFrame:
    """One row per material (also those without fibers), and one for the whole: level, name, counts, lengths, volumes, tensor.

    Segments are summed per fiber before anything is joined; the joins and the second level see one row per fiber.
    """
    s = sg.segments(v)
    solid = F.col("len") > sg.TINY
    unit = {c: g.ratio(F.col(f"{c}2") - F.col(c), F.col("len")) for c in "xyz"}
    per_fiber = s.groupBy("fiber_id").agg(
        F.count("*").alias("segments"),
        F.sum(F.when(solid, F.col("len")).otherwise(0.0)).alias("length"),
        *[F.sum(F.when(solid, F.col("len") * unit[a[0]] * unit[a[1]]).otherwise(0.0)).alias(a) for a in AXES],
    )
    f = per_fiber.join(fibers, "fiber_id").withColumn("volume", F.lit(math.pi) * F.col("radius") * F.col("radius") * F.col("length"))
    area = F.lit(math.pi) * F.col("radius") * F.col("radius")
    sums = [
        F.count("fiber_id").alias("fibers"),
        F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"),
        F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        *[F.coalesce(F.sum(F.col(a)), F.lit(0.0)).alias(f"l{a}") for a in AXES],
        *[F.coalesce(F.sum(F.col(a) * area), F.lit(0.0)).alias(f"v{a}") for a in AXES],
    ]
    grouped = materials.join(f, "material_id", "left").groupBy("material_id", "name").agg(*sums)
    named = [c for c in grouped.columns if c not in ("material_id", "name")]
    by_material = grouped.select(F.lit("material").alias("level"), F.col("name"), *named)
    total = grouped.groupBy().agg(*[F.sum(c).alias(c) for c in named]).select(F.lit("total").alias("level"), F.lit("all").alias("name"), *named)
    both = by_material.unionByName(total)
    share = lambda k, w: F.coalesce(g.ratio(F.col(k), F.col(w)), F.lit(0.0))
    return both.select(
        "level", "name", "fibers", "segments", "length", "volume", (F.col("volume") / F.lit(cell_volume)).alias("volume_fraction"),
        *[share(f"l{a}", "length").alias(f"length_{a}") for a in AXES],
        *[share(f"v{a}", "volume").alias(f"volume_{a}") for a in AXES],
    )
