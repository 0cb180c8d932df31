"""Ordered operators: arcs, duplicates, resampling, correlation along fibers, runs and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filamenta.operators import segments as sg
from filamenta.operators import shape
from filamenta.plans.measures import rounded
from filamenta.plans.registry import query
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views

STEP = 40.0
LAGS = [1, 2, 3, 5, 8, 13]


@query(with_views("SELECT fiber_id, seq, round(a0, 6) AS a0, round(a1, 6) AS a1, round(total, 6) AS total, last FROM arcs", "arcs"))
def vertex_arc_lengths(spark, sf_dir):
    return rounded(sg.arcs(ad.vertices(spark, sf_dir)).select("fiber_id", "seq", "a0", "a1", "total", "last"))


@query(
    with_views(
        """, g AS (SELECT fiber_id, seq, round(x / 40) AS x, round(y / 200) AS y, z FROM vertices),
d AS (SELECT *, lag(x) OVER w IS DISTINCT FROM x OR lag(y) OVER w IS DISTINCT FROM y OR lag(z) OVER w IS DISTINCT FROM z AS moved FROM g WINDOW w AS (PARTITION BY fiber_id ORDER BY seq))
SELECT fiber_id, row_number() OVER (PARTITION BY fiber_id ORDER BY seq) - 1 AS seq, x, y, z FROM d WHERE moved""",
        "vertices",
    )
)
def without_duplicates(spark, sf_dir):
    """Consecutive equal vertices, on a coarse grid, are one."""
    v = ad.vertices(spark, sf_dir)
    coarse = v.select("fiber_id", "seq", F.round(F.col("x") / 40).alias("x"), F.round(F.col("y") / 200).alias("y"), "z")
    return sg.without_duplicates(coarse)


_RESAMPLED = f""", rs AS (SELECT fiber_id, k, k * {STEP} AS s, x + (x2 - x) * t AS x, y + (y2 - y) * t AS y, z + (z2 - z) * t AS z, (x2 - x) / len AS tx, (y2 - y) / len AS ty, (z2 - z) / len AS tz
  FROM (SELECT *, least(greatest((k * {STEP} - a0) / len, 0), 1) AS t FROM (SELECT *, unnest(range(CAST(ceil(a0 / {STEP}) AS BIGINT), CAST(floor(a1 / {STEP}) AS BIGINT) + 1)) AS k FROM arcs WHERE len > 0)
    WHERE k * {STEP} >= a0 AND (k * {STEP} < a1 OR (last AND k * {STEP} <= a1))))
"""


@query(with_views(_RESAMPLED + "SELECT fiber_id, k, s, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM rs", "arcs"))
def resampled(spark, sf_dir):
    return rounded(sg.resampled(ad.vertices(spark, sf_dir), STEP))


@query(
    with_views(
        """, n AS (SELECT *, greatest(1, round_even(total / 25.0, 0)) AS n FROM arcs WHERE total > 0)
SELECT fiber_id, k, round(x + (x2 - x) * t, 6) AS x, round(y + (y2 - y) * t, 6) AS y, round(z + (z2 - z) * t, 6) AS z
FROM (SELECT *, least(greatest(CASE WHEN len > 0 THEN (k * (total / n) - a0) / len ELSE 0 END, 0), 1) AS t
  FROM (SELECT *, unnest(range(CAST(ceil(a0 / (total / n)) AS BIGINT), CAST(CASE WHEN last THEN n + 1 ELSE ceil(a1 / (total / n)) END AS BIGINT))) AS k FROM n))""",
        "arcs",
    )
)
def resampled_even(spark, sf_dir):
    return rounded(sg.resampled_even(ad.vertices(spark, sf_dir), 25.0))


_CHORDS = _RESAMPLED + """, ch AS (SELECT fiber_id, k, dx / n AS tx, dy / n AS ty, dz / n AS tz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM (
  SELECT fiber_id, k, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM rs WINDOW w AS (PARTITION BY fiber_id ORDER BY k))) WHERE n > 0)
"""


@query(with_views(_CHORDS + "SELECT fiber_id, k, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz FROM ch", "arcs"))
def chord_tangents(spark, sf_dir):
    return rounded(shape.chords(sg.resampled(ad.vertices(spark, sf_dir), STEP)))


@query(
    with_views(
        _CHORDS
        + f""", p AS (SELECT fiber_id, k, tx, ty, tz, lead(tx) OVER w AS ux, lead(ty) OVER w AS uy, lead(tz) OVER w AS uz, lead(tx, 2) OVER w AS vx, lead(ty, 2) OVER w AS vy, lead(tz, 2) OVER w AS vz FROM ch WINDOW w AS (PARTITION BY fiber_id ORDER BY k)),
c AS (SELECT *, ty * uz - tz * uy AS mx, tz * ux - tx * uz AS my, tx * uy - ty * ux AS mz, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM p WHERE ux IS NOT NULL)
SELECT fiber_id, k, round(atan2(sqrt(mx * mx + my * my + mz * mz), tx * ux + ty * uy + tz * uz) / {STEP}, 6) AS curvature,
  CASE WHEN sqrt(mx * mx + my * my + mz * mz) > 1e-9 AND sqrt(nx * nx + ny * ny + nz * nz) > 1e-9 THEN round(atan2(ux * (my * nz - mz * ny) + uy * (mz * nx - mx * nz) + uz * (mx * ny - my * nx), mx * nx + my * ny + mz * nz) / {STEP}, 6) + 0.0 END AS torsion FROM c""",
        "arcs",
    )
)
def curvature_torsion(spark, sf_dir):
    return rounded(shape.sample_curvature(sg.resampled(ad.vertices(spark, sf_dir), STEP), STEP))


_CORRELATION = _CHORDS + f""", co AS (SELECT lag, avg(a.tx * b.tx + a.ty * b.ty + a.tz * b.tz) AS correlation, count(*) AS pairs FROM (SELECT unnest({LAGS}) AS lag) l, ch a JOIN ch b ON a.fiber_id = b.fiber_id AND b.k = a.k + lag GROUP BY 1)
"""


@query(with_views(_CORRELATION + "SELECT lag, round(correlation, 6) AS correlation, pairs FROM co", "arcs"))
def tangent_correlation(spark, sf_dir):
    return rounded(shape.tangent_correlation(sg.resampled(ad.vertices(spark, sf_dir), STEP), LAGS))


@query(with_views(_CORRELATION + f", k AS (SELECT *, max(CASE WHEN correlation < 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY lag) AS low FROM co), f AS (SELECT sum(lag * {STEP} * lag * {STEP}) AS n, sum(lag * {STEP} * ln(correlation)) FILTER (correlation < 1 - 1e-12) AS d FROM k WHERE low = 0) SELECT CASE WHEN d < 0 THEN round(-n / d, 4) END AS persistence_length FROM f", "arcs"))
def persistence_length(spark, sf_dir):
    c = shape.tangent_correlation(sg.resampled(ad.vertices(spark, sf_dir), STEP), LAGS)
    return rounded(shape.persistence(c, STEP), 4)


@query(
    with_views(
        _CORRELATION
        + f""", d AS (SELECT lag, correlation AS c, lag(correlation, 1, 1.0) OVER (ORDER BY lag) AS c0, lag(lag, 1, 0) OVER (ORDER BY lag) AS l0 FROM co)
SELECT round(min_by((l0 + (lag - l0) * (c0 - exp(-1)) / (c0 - c)) * {STEP}, lag), 4) AS decay_length FROM d WHERE c <= exp(-1)""",
        "arcs",
    )
)
def decay_length(spark, sf_dir):
    c = shape.tangent_correlation(sg.resampled(ad.vertices(spark, sf_dir), STEP), LAGS)
    return rounded(shape.decay_length(c, STEP), 4)


@query(
    with_views(
        """, e AS (SELECT fiber_id, min_by(x, seq) AS x0, min_by(y, seq) AS y0, min_by(z, seq) AS z0, max_by(x, seq) AS x1, max_by(y, seq) AS y1, max_by(z, seq) AS z1 FROM vertices GROUP BY 1), l AS (SELECT fiber_id, sum(len) AS length FROM segs GROUP BY 1)
SELECT fiber_id, round(length / nullif(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2), 0) - 1, 6) AS curl FROM e JOIN l USING (fiber_id) WHERE length > 0""",
        "segs",
    )
)
def curl(spark, sf_dir):
    return rounded(shape.curl(ad.vertices(spark, sf_dir)))


_BETAS = [0.25, 0.5, 1.0, 2.0, 4.0]


@query(
    with_views(
        f""", c AS (SELECT abs(y2 - y) / len AS c FROM segs WHERE len > 2.220446049250313e-16)
SELECT beta, round(avg(ln(beta) - 1.5 * ln(1 + (beta * beta - 1) * c * c)), 6) AS loglik FROM c, (SELECT CAST(unnest({_BETAS}) AS DOUBLE) AS beta) GROUP BY 1""",
        "segs",
    )
)
def schladitz_fit_grid(spark, sf_dir):
    t = sg.tangents(sg.segments(ad.vertices(spark, sf_dir))).select(F.abs("ty").alias("c"))
    return rounded(shape.schladitz_likelihood(t, "c", _BETAS))


@query(
    with_views(
        f""", c AS MATERIALIZED (SELECT ((y2 - y) / len) ** 2 AS q FROM segs WHERE len > 2.220446049250313e-16),
b AS (SELECT 0 AS i, CAST(-{shape.LOG_BETA} AS DOUBLE) AS lo, CAST({shape.LOG_BETA} AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN s > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s > 0 THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, (SELECT count(*) - 3 * sum(exp(lo + hi) * q / (1 + (exp(lo + hi) - 1) * q)) FROM c) AS s FROM b WHERE i < 60))
SELECT (SELECT count(*) FROM c) AS samples, round(exp((lo + hi) / 2), 6) AS beta FROM b WHERE i = 60""",
        "segs",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def schladitz_fit(spark, sf_dir):
    """The axial model's beta of greatest likelihood for the segments' angles to the y axis."""
    t = sg.tangents(sg.segments(ad.vertices(spark, sf_dir))).select(F.abs("ty").alias("c"))
    n, beta = shape.schladitz_fit(t, "c")
    return spark.createDataFrame([(n, None if beta is None else round(beta, 6))], "samples long, beta double")


@query(
    with_views(
        f""", o AS (SELECT quantile_cont(c, [0, {", ".join(str(i / 100) for i in range(1, 101))}]) AS q FROM (SELECT abs(y2 - y) / len AS c FROM segs WHERE len > 2.220446049250313e-16))
SELECT round(sum(abs(q[i + 1] - (i / 100.0) / sqrt(4 - 3 * (i / 100.0) * (i / 100.0))) * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1 END) / 100, 6) AS distance FROM o, range(0, 101) r(i)""",
        "segs",
    )
)
def schladitz_distance(spark, sf_dir):
    """Wasserstein distance between observed axis cosines and the model at beta 2."""
    from filamenta.operators.distribution import quantile_rows

    t = sg.tangents(sg.segments(ad.vertices(spark, sf_dir))).select(F.abs("ty").alias("c"))
    q = quantile_rows(t, "c", 101)
    u = F.col("k") / F.lit(100.0)
    d = F.abs(F.col("q") - shape.schladitz_quantile(u, 2.0)) * F.when(F.col("k").isin(0, 100), 0.5).otherwise(1.0)
    return q.agg(F.round(F.sum(d) / 100, 6).alias("distance"))


@query(
    with_views(
        """, n AS (SELECT fiber_id, seq, coalesce(lag(x) OVER w, x) AS a, x AS b, coalesce(lead(x) OVER w, x) AS c FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq))
SELECT fiber_id, seq, round(greatest(least(a, b), least(greatest(a, b), c)), 6) AS x FROM n""",
        "vertices",
    )
)
def median_of_three(spark, sf_dir):
    """Smoothing by the median of three neighbours, edges repeated."""
    w = sg.along()
    a, b, c = F.coalesce(F.lag("x").over(w), F.col("x")), F.col("x"), F.coalesce(F.lead("x").over(w), F.col("x"))
    out = ad.vertices(spark, sf_dir).select("fiber_id", "seq", F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)).alias("x"))
    return rounded(out)


@query(
    with_views(
        """, f AS (SELECT fiber_id, seq, x, seq - row_number() OVER (PARTITION BY fiber_id ORDER BY seq) AS island FROM vertices WHERE x > 20)
SELECT fiber_id, min(seq) AS start, count(*) AS n, round(avg(x), 6) AS mean FROM f GROUP BY fiber_id, island HAVING count(*) >= 2""",
        "vertices",
    )
)
def keep_runs(spark, sf_dir):
    """Maximal runs of at least two consecutive vertices that pass a test."""
    w = Window.partitionBy("fiber_id").orderBy("seq")
    f = ad.vertices(spark, sf_dir).where("x > 20").withColumn("island", F.col("seq") - F.row_number().over(w))
    runs = f.groupBy("fiber_id", "island").agg(F.min("seq").alias("start"), F.count("*").alias("n"), F.avg("x").alias("mean"))
    return rounded(runs.where("n >= 2").drop("island"))


@query(
    """WITH p AS (SELECT vec_id, unnest(range(len(embedding))) AS r, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, max(v) AS peak, min(r) FILTER (v = pm) AS at, max(r) AS last FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS pm FROM p) GROUP BY 1),
n AS (SELECT p.vec_id, p.r, p.v, lag(p.v) OVER (PARTITION BY p.vec_id ORDER BY p.r) AS pv, peak, m."at", last FROM p JOIN m USING (vec_id)),
h AS (SELECT vec_id, min_by(r - 1 + (pv - peak / 2) / (pv - v), r) AS r FROM n WHERE r > "at" AND v < peak / 2 GROUP BY 1)
SELECT m.vec_id, round(CASE WHEN peak <= 0 THEN 0 ELSE coalesce(h.r, last) END, 6) AS half_radius FROM m LEFT JOIN h USING (vec_id)"""
)
def half_radius(spark, sf_dir):
    """First radius past a profile's peak where it falls below half of it, interpolated; arrays are scanned in place."""
    from filamenta.session import table

    e = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = e.select("vec_id", v.alias("v")).withColumn("peak", F.array_max("v"))
    e = e.withColumn("top", F.array_position("v", F.col("peak")).cast("int"))  # from 1
    r = F.sequence(F.lit(1), F.size("v"))
    below = F.filter(r, lambda i: (i > F.col("top")) & (F.element_at("v", i) < F.col("peak") / 2))
    i = F.get(below, F.lit(0))
    a, b = F.element_at("v", i - 1), F.element_at("v", i)
    at = i - 2 + (a - F.col("peak") / 2) / (a - b)
    value = F.when(F.col("peak") <= 0, 0.0).when(i.isNull(), (F.size("v") - 1).cast("double")).otherwise(at)
    return rounded(e.select("vec_id", value.alias("half_radius")))


@query(
    with_views(
        """, q AS (SELECT fiber_id, f, f * total AS s, a.* EXCLUDE (fiber_id) FROM arcs a, (SELECT CAST(unnest([0.1, 0.35, 0.8]) AS DOUBLE) AS f))
SELECT fiber_id, f, seq, round(s, 6) AS s, round(x + (x2 - x) * (s - a0) / len, 6) AS px, round(y + (y2 - y) * (s - a0) / len, 6) AS py, round(z + (z2 - z) * (s - a0) / len, 6) AS pz
FROM q WHERE len > 0 AND s >= a0 AND (s < a1 OR (last AND s <= a1))""",
        "arcs",
    )
)
def anchor_points(spark, sf_dir):
    """As-of join: arc length to segment and point."""
    v = ad.vertices(spark, sf_dir)
    total = sg.segments(v).groupBy("fiber_id").agg(F.sum("len").alias("whole"))
    asked = total.select("fiber_id", "whole", F.explode(F.array(*[F.lit(f) for f in (0.1, 0.35, 0.8)])).alias("f")).withColumn("s", F.col("f") * F.col("whole"))
    return rounded(sg.point_at(v, asked).where("len > 0").select("fiber_id", "f", "seq", "s", "px", "py", "pz"))
