"""Shape of resampled fibers: curvature and torsion, tangent correlation, persistence, curl, and the Schladitz model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg

#: Fixed value: correlations this close to 1 count as straight.
STRAIGHT = 1e-12


def chords(samples: DataFrame) -> DataFrame:
    """(fiber_id, k, tx, ty, tz): unit chords from sample k to k + 1; null where both coincide."""
    from pyspark.sql import Window

    w = Window.partitionBy("fiber_id").orderBy("k")
    d = samples.withColumns({f"d{c}": F.lead(c).over(w) - F.col(c) for c in "xyz"}).where("dx is not null")
    n = g.norm(g.vec("d"))
    return d.select("fiber_id", "k", *[g.ratio(F.col(f"d{c}"), n).alias(f"t{c}") for c in "xyz"])


def sample_curvature(samples: DataFrame, spacing: float) -> DataFrame:
    """(fiber_id, k, curvature, torsion): turn over spacing, and the signed dihedral of three chords over spacing.

    Torsion is null where two of the three chords are parallel.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("fiber_id").orderBy("k")
    t = chords(samples)
    t = t.withColumns({f"{p}{c}": F.lead(f"t{c}", n).over(w) for c in "xyz" for p, n in (("u", 1), ("v", 2))}).where("ux is not null")
    a, b, c = g.vec("t"), g.vec("u"), g.vec("v")
    m, n = g.cross(a, b), g.cross(b, c)
    torsion = F.atan2(g.dot(b, g.cross(m, n)), g.dot(m, n)) / spacing
    return t.select("fiber_id", "k", (g.angle(a, b) / spacing).alias("curvature"), F.when((g.norm(m) > 1e-9) & (g.norm(n) > 1e-9), torsion).alias("torsion"))


def tangent_correlation(samples: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, correlation, pairs): the mean of t(k) . t(k + lag). Each chord sends itself once per lag to its partner's key."""
    t = chords(samples).where("tx is not null")
    late = t.select("fiber_id", F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag"), F.col("k").alias("k0"), *[F.col(f"t{c}").alias(f"u{c}") for c in "xyz"]).withColumn("k", F.col("k0") - F.col("lag")).where("k >= 0")
    p = late.join(t, ["fiber_id", "k"])
    return p.groupBy("lag").agg(F.avg(g.dot(g.vec("t"), g.vec("u"))).alias("correlation"), F.count("*").alias("pairs"))


def lag_steps(most: int, count: int) -> list[int]:
    """Whole lags from 1 to ``most``, evenly spaced in the logarithm, repeats dropped."""
    if most < 1:
        return []
    steps = [int(most ** (i / max(1, count - 1)) + 0.5) for i in range(count)]
    return sorted({max(1, s) for s in steps})


def persistence(correlation: DataFrame, spacing: float, least: float = 0.05) -> DataFrame:
    """Persistence length L of a correlation that decays as exp(-s / L), fitted to its logarithm over the lags before it first is below ``least``.

    Values that are 1 but for rounding have no decay, and add to the lags' squares alone; without any decay there is no
    length. The curve has one row per lag, so its window over all rows stays small.
    """
    from pyspark.sql import Window

    c = correlation.where("correlation is not null")
    low = F.max(F.when(F.col("correlation") < least, 1).otherwise(0)).over(Window.orderBy("lag"))
    s = F.col("lag") * spacing
    kept = c.withColumn("low", low).where("low = 0")
    decay = F.sum(F.when(F.col("correlation") < 1 - STRAIGHT, s * F.ln("correlation")))
    return kept.agg(F.when(decay < 0, -F.sum(s * s) / decay).alias("persistence_length"))


def decay_length(correlation: DataFrame, spacing: float) -> DataFrame:
    """First crossing of 1/e, interpolated from (0, 1)."""
    from pyspark.sql import Window

    w = Window.orderBy("lag")
    at = F.lit(0.36787944117144233)
    c = correlation.where("correlation is not null").withColumns({"c0": F.lag("correlation", 1, 1.0).over(w), "l0": F.lag("lag", 1, 0).over(w)})
    x = (F.col("l0") + (F.col("lag") - F.col("l0")) * (F.col("c0") - at) / (F.col("c0") - F.col("correlation"))) * spacing
    return c.where(F.col("correlation") <= at).agg(F.min_by(x, "lag").alias("decay_length"))


def curl(v: DataFrame) -> DataFrame:
    """(fiber_id, curl): length over end-to-end distance, less 1; null for a closed fiber."""
    from filamenta.operators.metrics import fiber_lengths

    f = fiber_lengths(v).where("length > 0")
    return f.select("fiber_id", (g.ratio(F.col("length"), F.col("end_to_end")) - 1).alias("curl"))


def schladitz_quantile(u: Column, beta: float) -> Column:
    """|cos| of the angle to the axis at probability u under the one-parameter axial model."""
    b2 = beta * beta
    return u / F.sqrt(F.lit(b2) - (F.lit(b2) - 1) * u * u) if beta != 1.0 else u


def schladitz_likelihood(cosines: DataFrame, column: str, betas: list[float]) -> DataFrame:
    """(beta, loglik): mean log-likelihood ln(beta) - 1.5 ln(1 + (beta^2 - 1) c^2) for each candidate, in one pass."""
    c = F.col(column)
    sums = [F.avg(F.lit(1.0) * F.ln(F.lit(b)) - 1.5 * F.ln(1 + (b * b - 1) * c * c)).alias(f"b{i}") for i, b in enumerate(betas)]
    row = cosines.agg(*sums)
    pairs = F.array(*[F.struct(F.lit(b).alias("beta"), F.col(f"b{i}").alias("loglik")) for i, b in enumerate(betas)])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


#: The fit's bounds of ln(beta), a fixed value.
LOG_BETA = 12.0


def schladitz_fit(cosines: DataFrame, column: str) -> tuple[int, float | None]:
    """(samples, beta) of greatest likelihood for the cosines of angles to the axis; no beta without samples.

    The likelihood is concave in ln(beta), so its slope has one root: Newton's steps, halved into the bracket where they
    leave it. A step is one aggregate of two sums. Where the slope keeps its sign, as for fibers all along or all across the
    axis, beta is the bound.
    """
    squares = cosines.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.least(F.col(column) * F.col(column), F.lit(1.0)).alias("q"))

    def slopes(points: list[float]) -> tuple[int, list[tuple[float, float]]]:
        sums = [F.count("*")]
        for x in points:
            b2 = math.exp(2 * x)
            under = 1 + (b2 - 1) * F.col("q")
            sums += [F.sum(b2 * F.col("q") / under), F.sum(b2 * F.col("q") * (1 - F.col("q")) / (under * under))]
        row = squares.agg(*sums).first()
        return row[0], [(row[0] - 3 * (row[1 + 2 * k] or 0.0), -6 * (row[2 + 2 * k] or 0.0)) for k in range(len(points))]

    grid = [k - LOG_BETA for k in range(int(2 * LOG_BETA) + 1)]
    n, found = slopes(grid)
    if not n:
        return 0, None
    if found[0][0] <= 0 or found[-1][0] >= 0:
        return n, math.exp(grid[0] if found[0][0] <= 0 else grid[-1])
    k = max(i for i, (slope, _) in enumerate(found) if slope > 0)
    low, high, x = grid[k], grid[k + 1], 0.5 * (grid[k] + grid[k + 1])
    for _ in range(60):
        (slope, bend), = slopes([x])[1]
        low, high = (x, high) if slope > 0 else (low, x)
        step = x - slope / bend if bend < 0 else low
        x, last = step if low < step < high else 0.5 * (low + high), x
        if abs(x - last) < 1e-12:
            break
    return n, math.exp(x)


def sample_segments(v: DataFrame, step: float) -> DataFrame:
    """Resampled points with their segment's unit tangent."""
    return sg.resampled(v, step, tangent=True)
