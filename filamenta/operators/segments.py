"""Segments, arcs, curvature and resampling of ordered polylines.

Polylines are rows (fiber_id, seq, x, y, z). Windows run per fiber, so one shuffle on fiber_id serves everything that is
computed along a fiber.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g

TINY = 2.220446049250313e-16


def along(*keys: str):
    return Window.partitionBy(*(keys or ("fiber_id",))).orderBy("seq")


def segments(v: DataFrame) -> DataFrame:
    """(fiber_id, seq, x, y, z, x2, y2, z2, len): vertices with their successor; the last vertex starts no segment."""
    w = along()
    out = v.withColumns({f"{c}2": F.lead(c).over(w) for c in "xyz"}).where("x2 is not null")
    return out.withColumn("len", g.norm(g.sub(g.vec(suffix="2"), g.vec())))


def arcs(v: DataFrame) -> DataFrame:
    """Segments with arc lengths: a0 at the start, a1 at the end, the fiber's total, and whether the segment is the last."""
    w, whole = along(), Window.partitionBy("fiber_id")
    s = segments(v).withColumn("a1", F.sum("len").over(w)).withColumn("a0", F.col("a1") - F.col("len"))
    return s.withColumn("total", F.sum("len").over(whole)).withColumn("last", F.col("seq") == F.max("seq").over(whole))


def tangents(s: DataFrame) -> DataFrame:
    """Segments with unit tangents tx, ty, tz; segments of no length are dropped."""
    d = g.sub(g.vec(suffix="2"), g.vec())
    return s.where(F.col("len") > TINY).withColumns({f"t{c}": x / F.col("len") for c, x in zip("xyz", d, strict=True)})


def without_duplicates(v: DataFrame) -> DataFrame:
    """Vertices that differ from the one before, numbered anew."""
    w = along()
    moved = [F.lag(c).over(w).isNull() | (F.lag(c).over(w) != F.col(c)) for c in "xyz"]
    kept = v.withColumn("_keep", moved[0] | moved[1] | moved[2]).where("_keep").drop("_keep")
    return kept.withColumn("seq", F.row_number().over(w) - 1)


def vertex_curvature(v: DataFrame) -> DataFrame:
    """(fiber_id, seq, curvature): 2 sin(turn / 2) over the mean adjacent length; null beside a segment of no length."""
    w = along()
    p = v.withColumns({f"{c}{k}": F.lag(c).over(w) if k == 0 else F.lead(c).over(w) for c in "xyz" for k in (0, 2)}).where("x0 is not null and x2 is not null")
    a, b = g.sub(g.vec(), g.vec(suffix="0")), g.sub(g.vec(suffix="2"), g.vec())
    la, lb = g.norm(a), g.norm(b)
    turn = g.safe_acos(g.ratio(g.dot(a, b), la * lb))
    k = 2 * F.sin(turn / 2) / ((la + lb) / 2)
    return p.select("fiber_id", "seq", F.when((la > TINY) & (lb > TINY), k).alias("curvature"))


def maximum_curvature(v: DataFrame) -> DataFrame:
    """(fiber_id, max_curvature), 0 where a fiber has no interior vertex."""
    k = vertex_curvature(v).groupBy("fiber_id").agg(F.max("curvature").alias("m"))
    return v.select("fiber_id").distinct().join(k, "fiber_id", "left").select("fiber_id", F.coalesce("m", F.lit(0.0)).alias("max_curvature"))


def vertex_tangents(v: DataFrame) -> DataFrame:
    """Central differences, one-sided at the ends, as unit vectors; null where both neighbours coincide."""
    w = along()
    d = tuple(F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz")
    out = v.withColumns({f"d{c}": x for c, x in zip("xyz", d, strict=True)})
    n = g.norm(g.vec("d"))
    return out.select("fiber_id", "seq", *[g.ratio(F.col(f"d{c}"), n).alias(f"t{c}") for c in "xyz"])


def _placed(a: DataFrame, s: Column) -> DataFrame:
    t = g.clamp(F.coalesce(g.ratio(s - F.col("a0"), F.col("len")), F.lit(0.0)), 0.0, 1.0)
    p = g.lerp(g.vec(), g.vec(suffix="2"), t)
    return a.withColumns({"px": p[0], "py": p[1], "pz": p[2]})


def resampled(v: DataFrame, step: float, tangent: bool = False) -> DataFrame:
    """Points at 0, step, 2 step, ... along each fiber: (fiber_id, k, s, x, y, z).

    A sample on a vertex lies in the later segment, but in the last one at the end. Each segment makes its own samples, so
    nothing is joined.
    """
    a = arcs(v).where((F.col("len") > 0) | F.col("last"))
    first = F.ceil(F.col("a0") / step)
    stop = F.when(F.col("last"), F.floor(F.col("a1") / step)).otherwise(F.ceil(F.col("a1") / step) - 1)
    made = a.withColumn("k", F.explode(F.when(stop >= first, F.sequence(first, stop)))).withColumn("s", F.col("k") * F.lit(float(step)))
    out = _placed(made, F.col("s"))
    extra = [((F.col(f"{c}2") - F.col(c)) / F.col("len")).alias(f"t{c}") for c in "xyz"] if tangent else []
    return out.select("fiber_id", "k", "s", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), *extra)


def resampled_even(v: DataFrame, step: float) -> DataFrame:
    """Even intervals, as many as max(1, half-even rounding of length / step), both ends kept: (fiber_id, k, x, y, z)."""
    a = arcs(v).where("total > 0")
    n = F.greatest(F.lit(1.0), F.rint(F.col("total") / step))
    h = F.col("total") / n
    first = F.ceil(F.col("a0") / h)
    stop = F.when(F.col("last"), n.cast("long")).otherwise(F.ceil(F.col("a1") / h) - 1)
    made = a.withColumn("k", F.explode(F.when(stop >= first, F.sequence(first, stop)))).withColumn("s", F.col("k") * h)
    return _placed(made, F.col("s")).select("fiber_id", "k", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


def dense_segments(v: DataFrame, step: float = 1.0) -> DataFrame:
    """(fiber_id, x, y, z, x2, y2, z2, len, a0, h, first, stop): segments that hold the samples first ... stop of ``dense``.

    Sample k lies at arc length k h, the segment starts at a0. A fiber of no length is one segment of none.
    """
    a = arcs(v).where("total > 0")
    n = F.greatest(F.lit(1.0), F.ceil(F.round(F.col("total") / step, 9)).cast("double"))
    h = F.col("total") / n
    first = F.ceil(F.col("a0") / h)
    stop = F.when(F.col("last"), n.cast("long")).otherwise(F.ceil(F.col("a1") / h) - 1)
    ends = [*"xyz", "x2", "y2", "z2"]
    out = a.select("fiber_id", *ends, "len", "a0", h.alias("h"), first.alias("first"), stop.alias("stop")).where("stop >= first")
    w = along()
    step_to = F.coalesce(g.norm(tuple(F.lead(c).over(w) - F.col(c) for c in "xyz")), F.lit(0.0))
    still = v.withColumns({"_len": step_to, "_first": F.row_number().over(w) == 1}).withColumn("_total", F.sum("_len").over(Window.partitionBy("fiber_id")))
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    alone = still.where("_total = 0 and _first").select("fiber_id", *"xyz", *[F.col(c).alias(f"{c}2") for c in "xyz"], zero.alias("len"), zero.alias("a0"), F.lit(1.0).alias("h"), none.alias("first"), none.alias("stop"))
    return out.unionByName(alone)


def dense(v: DataFrame, step: float = 1.0) -> DataFrame:
    """Even samples at most ``step`` apart, both ends kept: (fiber_id, k, x, y, z). A fiber of no length is one sample."""
    made = dense_segments(v, step).withColumn("k", F.explode(F.sequence("first", "stop")))
    return _placed(made, F.col("k") * F.col("h")).select("fiber_id", "k", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))


def point_at(v: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of join: ``asked`` (fiber_id, s, ...) with the segment that holds arc length s and the point there.

    Fibers are joined on their id and segments by the range of their arc. s past the end or before 0 gives no row.
    """
    a = arcs(v)
    inside = (F.col("s") >= F.col("a0")) & ((F.col("s") < F.col("a1")) | (F.col("last") & (F.col("s") <= F.col("a1"))))
    return _placed(asked.join(a, "fiber_id").where(inside), F.col("s"))
