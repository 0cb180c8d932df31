"""Bonded-particle models: spheres and capsules along fibers, bonds, bridges, types and wrapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg


def _at(a: DataFrame, s: Column) -> DataFrame:
    t = g.clamp(F.coalesce(g.ratio(s - F.col("a0"), F.col("len")), F.lit(0.0)), 0.0, 1.0)
    return a.select("fiber_id", "k", *[(F.col(c) + (F.col(f"{c}2") - F.col(c)) * t).alias(c) for c in "xyz"])


def exact_spheres(v: DataFrame, spacing: float) -> DataFrame:
    """(fiber_id, k, x, y, z): samples exactly ``spacing`` apart, the leftover split between both ends.

    The number of intervals is floor(length / spacing), or the next whole number within 1e-12; a shorter fiber has one
    sample in its middle. Each segment makes its own samples.
    """
    a = sg.arcs(v).where("total > 0")
    n = F.floor(F.col("total") / spacing + 1e-12)
    start = F.when(n >= 1, (F.col("total") - n * spacing) / 2).otherwise(F.col("total") / 2)
    a = a.withColumns({"n": n, "start": start})
    first = F.greatest(F.lit(0), F.ceil((F.col("a0") - F.col("start")) / spacing))
    stop = F.when(F.col("last"), F.col("n")).otherwise(F.least(F.col("n"), F.ceil((F.col("a1") - F.col("start")) / spacing) - 1))
    made = a.withColumn("k", F.explode(F.when(stop >= first, F.sequence(first, stop))))
    return _at(made, F.col("start") + F.col("k") * spacing)


def dynamic_spheres(v: DataFrame, spacing: float) -> DataFrame:
    """(fiber_id, seq, j, x, y, z): each segment in max(1, round(length / spacing)) equal parts, vertices kept."""
    s = sg.arcs(v)
    parts = F.greatest(F.lit(1), F.round(F.col("len") / spacing).cast("int"))
    s = s.withColumn("parts", parts)
    s = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("last"), F.col("parts")).otherwise(F.col("parts") - 1))))
    return s.select("fiber_id", "seq", "j", *[(F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("j") / F.col("parts")).alias(c) for c in "xyz"])


def even_spheres(v: DataFrame, fibers: DataFrame, ratio: float) -> DataFrame:
    """(fiber_id, k, x, y, z): ceil(length / (2 radius ratio)) equal intervals with both ends."""
    a = sg.arcs(v).where("total > 0").join(fibers.select("fiber_id", "radius"), "fiber_id")
    a = a.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / (2 * F.col("radius") * ratio)))).withColumn("h", F.col("total") / F.col("n"))
    first, stop = F.ceil(F.col("a0") / F.col("h")), F.when(F.col("last"), F.col("n")).otherwise(F.ceil(F.col("a1") / F.col("h")) - 1)
    made = a.withColumn("k", F.explode(F.when(stop >= first, F.sequence(first, stop))))
    return _at(made, F.col("k") * F.col("h"))


def constant_capsules(v: DataFrame, target: float, least: float) -> DataFrame:
    """(fiber_id, seq, j, start, length): segments tiled by capsules of ``target``; a rest below ``least`` joins the last."""
    s = sg.segments(v).where("len > 0")
    whole = F.floor(F.col("len") / target)
    rest = F.col("len") - whole * target
    n = F.when(whole < 1, 1).when(rest > least, whole + 1).otherwise(whole)
    s = s.withColumns({"n": n, "rest": rest}).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.col("j") == F.col("n") - 1
    return s.select("fiber_id", "seq", "j", (F.col("j") * F.lit(target)).alias("start"), F.when(last, F.col("len") - F.col("j") * target).otherwise(F.lit(target)).alias("length"))


def capsules(v: DataFrame, fibers: DataFrame) -> DataFrame:
    """One spherocylinder per segment: centre, length, radius and the quaternion that takes z to its direction."""
    t = sg.tangents(sg.segments(v)).join(fibers.select("fiber_id", "radius"), "fiber_id")
    q = z_quaternion(g.vec("t"))
    mid = [((F.col(c) + F.col(f"{c}2")) / 2).alias(f"c{c}") for c in "xyz"]
    return t.select("fiber_id", "seq", *mid, F.col("len").alias("length"), "radius", *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


def z_quaternion(d: g.Vec) -> tuple[Column, ...]:
    """(w, x, y, z) of the shortest rotation from +z to a unit vector; half a turn about x for -z."""
    w = F.sqrt(F.greatest((1 + d[2]) / 2, F.lit(0.0)))
    flip = w < 1e-9
    return (F.when(flip, 0.0).otherwise(w), F.when(flip, 1.0).otherwise(-d[1] / (2 * w)), F.when(flip, 0.0).otherwise(d[0] / (2 * w)), F.lit(0.0))


def consecutive_bonds(particles: DataFrame, order: list[str]) -> DataFrame:
    """(fiber_id, a, b): bonds between a fiber's consecutive particles, numbered within it from 0."""
    w = Window.partitionBy("fiber_id").orderBy(*order)
    p = particles.select("fiber_id", (F.row_number().over(w) - 1).alias("a"), F.count("*").over(Window.partitionBy("fiber_id")).alias("n"))
    return p.where(F.col("a") < F.col("n") - 1).select("fiber_id", "a", (F.col("a") + 1).alias("b"))


def wrapped(df: DataFrame, low: dict[str, float], length: dict[str, float]) -> DataFrame:
    """Coordinates wrapped into a periodic box, with the image they came from."""
    out = df
    for c in low:
        image = F.floor((F.col(c) - low[c]) / length[c])
        out = out.withColumn(f"i{c}", image).withColumn(c, F.col(c) - F.col(f"i{c}") * length[c])
    return out


def unwrapped(df: DataFrame, length: dict[str, float]) -> DataFrame:
    """Chains taken across periodic faces: the first point and the running sum of minimum-image steps (halves to even)."""
    w = sg.along()
    out = df
    for c, size in length.items():
        d = F.col(c) - F.lag(c).over(w)
        out = out.withColumn(f"_d{c}", F.coalesce(d - F.lit(size) * F.rint(d / size), F.col(c)))
    for c in length:
        out = out.withColumn(c, F.sum(f"_d{c}").over(w)).drop(f"_d{c}")
    return out


def capsule_inertia(mass: Column, radius: Column, length: Column) -> tuple[Column, Column]:
    """(about the axis, across it) of a cylinder with two hemispheres of uniform density."""
    cyl = F.lit(math.pi) * radius * radius * length
    caps = F.lit(4.0 / 3.0 * math.pi) * radius * radius * radius
    mc, mh = mass * cyl / (cyl + caps), mass * caps / (cyl + caps)
    along = mc * radius * radius / 2 + mh * 2 * radius * radius / 5
    across = mc * (length * length / 12 + radius * radius / 4) + mh * (2 * radius * radius / 5 + length * length / 4 + 3 * length * radius / 8)
    return along, across


def bridges(anchors: DataFrame, ratio: float, period: dict[str, float] | None = None) -> DataFrame:
    """(junction_id, idx, ...): from each junction's first anchor to every other, at the nearest periodic image.

    anchors: (junction_id, idx, x, y, z, radius).
    """
    first = anchors.where("idx = 0").select("junction_id", *[F.col(c).alias(f"{c}0") for c in "xyz"], F.col("radius").alias("radius0"))
    j = anchors.where("idx > 0").join(first, "junction_id")
    d = {c: g.minimum_image(F.col(c) - F.col(f"{c}0"), (period or {}).get(c, 1.0), c in (period or {})) for c in "xyz"}
    j = j.withColumns({f"d{c}": x for c, x in d.items()})
    return j.select("junction_id", "idx", *[f"{c}0" for c in "xyz"], *[(F.col(f"{c}0") + F.col(f"d{c}")).alias(f"{c}1") for c in "xyz"], g.norm(g.vec("d")).alias("length"), (ratio * F.least("radius", "radius0")).alias("radius"))
