"""Directors: the unit direction, across a fiber, of its section's first axis at every vertex.

Rows are (fiber_id, seq, x, y, z), directors (fiber_id, seq, dx, dy, dz). A section looks the same turned half round, so signs
are free; along a fiber they are chosen so that a director never turns by more than a right angle from the one before. That
sign is the parity of the turns so far, a running count, and needs no pass over the vertices in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg

#: When a direction counts as none, and how far a valid director may be from unit length and from a right angle.
NONE, TOLERANCE = 1e-9, 1e-3


def _x() -> g.Vec:
    return (F.lit(1.0), F.lit(0.0), F.lit(0.0))


def _unit(v: g.Vec, other: g.Vec) -> g.Vec:
    n = g.norm(v)
    return tuple(F.when(n > 0, a / n).otherwise(b) for a, b in zip(v, other, strict=True))


def _across(v: g.Vec, t: g.Vec) -> g.Vec:
    """v without its part along t."""
    along = g.dot(v, t) / F.nullif(g.dot(t, t), F.lit(0.0))
    return tuple(a - F.coalesce(along, F.lit(0.0)) * b for a, b in zip(v, t, strict=True))


def default_director(t: g.Vec) -> g.Vec:
    """Across the tangent and in the plane z = 0; where the tangent is along z, x."""
    flat = (-t[1], t[0], F.lit(0.0))
    lies = g.norm(flat) > NONE * g.norm(t)
    return tuple(F.when(lies, a).otherwise(b) for a, b in zip(_unit(flat, _x()), _unit(_across(_x(), t), _x()), strict=True))


def projected(d: g.Vec, t: g.Vec) -> g.Vec:
    """The director across the tangent; the default one where it is along the tangent."""
    off = _across(d, t)
    some = g.norm(off) > NONE * g.norm(d)
    return tuple(F.when(some, a).otherwise(b) for a, b in zip(_unit(off, _x()), default_director(t), strict=True))


def _tangents(v: DataFrame) -> DataFrame:
    """``v`` with unit tangents; x where a fiber has one vertex or its neighbours coincide."""
    w = sg.along()
    d = tuple(F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz")
    rows = v.withColumns({f"_t{c}": x for c, x in zip("xyz", d, strict=True)})
    return rows.withColumns({f"t{c}": x for c, x in zip("xyz", _unit(g.vec("_t"), _x()), strict=True)}).drop("_tx", "_ty", "_tz")


def _aligned(rows: DataFrame) -> DataFrame:
    w = sg.along()
    turn = sum(F.col(f"d{c}") * F.lag(f"d{c}").over(w) for c in "xyz")
    rows = rows.withColumn("_turn", F.round(turn, 12)).withColumn("_part", F.count_if(F.col("_turn") == 0).over(w))  # a right angle starts anew
    sign: Column = F.when(F.count_if(F.col("_turn") < 0).over(Window.partitionBy("fiber_id", "_part").orderBy("seq")) % 2 == 1, -1.0).otherwise(1.0)
    signed = rows.withColumn("_sign", sign)
    return signed.select("fiber_id", "seq", *[(F.col(f"d{c}") * F.col("_sign")).alias(f"d{c}") for c in "xyz"])


def default_directors(vertices: DataFrame) -> DataFrame:
    """(fiber_id, seq, dx, dy, dz) for every vertex."""
    d = default_director(g.vec("t"))
    return _aligned(_tangents(vertices).select("fiber_id", "seq", *[x.alias(f"d{c}") for c, x in zip("xyz", d, strict=True)]))


def orthonormalized(vertices: DataFrame, directors: DataFrame) -> DataFrame:
    """Given directors turned across their vertices' tangents, their signs aligned. A vertex without one gets the default."""
    rows = _tangents(vertices).join(directors, ["fiber_id", "seq"], "left")
    d = tuple(F.coalesce(F.col(f"d{c}"), F.lit(0.0)) for c in "xyz")
    return _aligned(rows.select("fiber_id", "seq", *[x.alias(f"d{c}") for c, x in zip("xyz", projected(d, g.vec("t")), strict=True)]))


def invalid(vertices: DataFrame, directors: DataFrame) -> DataFrame:
    """(fiber_id, directors): fibers with directors that are not unit vectors across the centreline, and how many."""
    rows = _tangents(vertices).join(directors, ["fiber_id", "seq"])
    d = g.vec("d")
    infinite = F.lit(False)
    for c in d:
        infinite |= c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = infinite | (F.abs(g.norm(d) - 1) > TOLERANCE) | (F.abs(g.dot(d, g.vec("t"))) > TOLERANCE)
    return rows.where(bad).groupBy("fiber_id").agg(F.count("*").alias("directors"))
