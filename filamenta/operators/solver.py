"""Relaxation as driver-controlled DataFrame steps: corrections, targets, walls, compaction, and the reduced metrics.

State is vertices (fiber_id, seq, x, y, z). A step is a plan over the state; between rounds the state is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg
from filamenta.session import staged


def internal_corrections(v: DataFrame, rest: float, stretch: float = 0.5, bend: float = 0.1) -> DataFrame:
    """(fiber_id, seq, dx, dy, dz): Jacobi stretch towards both neighbours, and half the pull to the chord of i - 2 and i + 2."""
    w = sg.along()
    p = v
    for k, n in (("a", -1), ("b", 1), ("c", -2), ("d", 2)):
        p = p.withColumns({f"{k}{c}": (F.lag(c, -n) if n < 0 else F.lead(c, n)).over(w) for c in "xyz"})

    def pull(k: str) -> g.Vec:
        d = g.sub(g.vec(k), g.vec())
        n = g.norm(d)
        s = F.when(n > 0, stretch / 2 * (n - rest) / F.nullif(n, F.lit(0.0)))
        return tuple(F.coalesce(x * s, F.lit(0.0)) for x in d)

    chord = tuple(F.coalesce(bend * ((F.col(f"c{c}") + F.col(f"d{c}")) / 2 - F.col(c)), F.lit(0.0)) for c in "xyz")
    total = g.add(g.add(pull("a"), pull("b")), chord)
    return p.select("fiber_id", "seq", *[x.alias(f"d{c}") for c, x in zip("xyz", total, strict=True)])


def contact_corrections(contacts: DataFrame, gap: float) -> DataFrame:
    """(fiber_id, seq, dx, dy, dz) per vertex from contacts with ax..az and bx..bz: half the penetration along the axis.

    A segment's correction goes to both its vertices; a vertex sums its two segments. Axes that cross (within 1e-9) give no
    direction and no push.
    """
    d = g.sub(g.vec("a"), g.vec("b"))
    n = g.norm(d)
    push = tuple(F.when(n > 1e-9, x * (gap - n) / (2 * F.nullif(n, F.lit(0.0)))) for x in d)
    both = contacts.withColumns({f"d{c}": x for c, x in zip("xyz", push, strict=True)})
    a = F.struct("fiber_id", "seq", "dx", "dy", "dz")
    b = F.struct(F.col("o_fiber_id").alias("fiber_id"), F.col("o_seq").alias("seq"), *[(-F.col(f"d{c}")).alias(f"d{c}") for c in "xyz"])
    # both sides of a contact from one row: a union would find all contacts twice
    s = both.select(F.inline(F.array(a, b))).groupBy("fiber_id", "seq").agg(*[F.avg(f"d{c}").alias(f"d{c}") for c in "xyz"])
    ends = s.withColumn("seq", F.explode(F.array("seq", F.col("seq") + 1)))
    return ends.groupBy("fiber_id", "seq").agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in "xyz"])


def shared_corrections(sums: DataFrame) -> DataFrame:
    """``contact_corrections`` (line, seq, dx, dy, dz) from what ``contacts.sums`` has of each segment."""
    means = [g.ratio(F.col(f"d{c}"), F.col("pushes")).alias(f"d{c}") for c in "xyz"]
    ends = sums.select("line", F.explode(F.array("seq", F.col("seq") + 1)).alias("seq"), *means)
    return ends.groupBy("line", "seq").agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in "xyz"])


def applied(v: DataFrame, corrections: DataFrame, most: float, walls: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Vertices moved by their corrections, no further than ``most`` and not beyond the walls."""
    n = g.norm(g.vec("d"))
    s = F.when(n > most, most / F.nullif(n, F.lit(0.0))).otherwise(1.0)
    out = v.join(corrections, ["fiber_id", "seq"], "left")
    moved = {c: F.coalesce(F.col(c) + F.col(f"d{c}") * s, F.col(c)) for c in "xyz"}
    return out.select("fiber_id", "seq", *[(g.clamp(moved[c], *walls[c]) if walls and c in walls else moved[c]).alias(c) for c in "xyz"])


def rigid_corrections(segment_pushes: DataFrame) -> DataFrame:
    """(fiber_id, dx, dy, dz): each fiber's deepest push, not the mean, which would cancel."""
    deep = F.max(F.struct(F.round(g.norm(g.vec("d")), 9).alias("n"), -F.col("seq"), "dx", "dy", "dz")).alias("b")
    return segment_pushes.groupBy("fiber_id").agg(deep).select("fiber_id", "b.dx", "b.dy", "b.dz")


def towards_layers(v: DataFrame, targets: DataFrame, axis: str, stiffness: float, most: float) -> DataFrame:
    """Fibers moved so that their centre approaches their layer's target: (target - centre) x stiffness, clamped."""
    c = v.groupBy("fiber_id", "layer").agg(F.avg(axis).alias("centre")).join(targets, "layer")
    step = c.select("fiber_id", g.clamp((F.col("target") - F.col("centre")) * stiffness, -most, most).alias("step"))
    return v.join(step, "fiber_id", "left").withColumn(axis, F.col(axis) + F.coalesce("step", F.lit(0.0))).drop("step")


def affine(v: DataFrame, old: dict[str, tuple[float, float]], new: dict[str, tuple[float, float]]) -> DataFrame:
    """Every vertex carried with the cell as it changes from ``old`` to ``new`` (origin, length) per axis."""
    return v.withColumns({c: F.lit(new[c][0]) + (F.col(c) - old[c][0]) * (new[c][1] / old[c][1]) for c in old})


def rigid_centres(v: DataFrame, old: dict[str, tuple[float, float]], new: dict[str, tuple[float, float]]) -> DataFrame:
    """Fiber centres carried with the cell; shapes kept."""
    w = Window.partitionBy("fiber_id")
    shift = {c: F.lit(new[c][0]) + (F.avg(c).over(w) - old[c][0]) * (new[c][1] / old[c][1]) - F.avg(c).over(w) for c in old}
    return v.withColumns({c: F.col(c) + shift[c] for c in old})


def within_walls(v: DataFrame, walls: dict[str, tuple[float, float]]) -> DataFrame:
    """Vertices clamped to the walls, with how far each was moved as ``reaction``."""
    moved = {c: g.clamp(F.col(c), *walls[c]) for c in walls}
    reaction = sum((F.abs(F.col(c) - m) for c, m in moved.items()), F.lit(0.0))
    return v.withColumn("reaction", reaction).withColumns(moved)


def step_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the largest and the mean displacement."""
    b = after.select("fiber_id", "seq", *[F.col(c).alias(f"n{c}") for c in "xyz"])
    d = g.norm(g.sub(g.vec("n"), g.vec()))
    return before.join(b, ["fiber_id", "seq"]).agg(F.max(d).alias("largest"), F.avg(d).alias("mean"))


def marked(ratios: DataFrame, threshold: float, least: int) -> DataFrame:
    """Fibers that have over ``threshold`` in at least ``least`` places: candidates for refinement."""
    n = ratios.where(F.col("ratio") > threshold).groupBy("fiber_id").agg(F.count("*").alias("places"))
    return n.where(F.col("places") >= least)


@dataclass
class Recipe:
    """Operations in order; each is a function of the state. ``run`` repeats them until the largest step is below ``settled``."""

    steps: list = field(default_factory=list)
    settled: float = 1e-3
    rounds: int = 20

    def run(self, v: DataFrame) -> tuple[DataFrame, int]:
        state = staged(v, "state")
        for n in range(1, self.rounds + 1):
            after = state
            for f in self.steps:
                after = f(after)
            after = staged(after, "state")
            largest = step_metrics(state, after).first()["largest"] or 0.0
            state = after
            if largest < self.settled:
                return state, n
        return state, self.rounds
