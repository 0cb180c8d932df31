"""Lengths, tensors, curvature, distributions, validation and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filamenta.operators import distribution, metrics, validation
from filamenta.operators import segments as sg
from filamenta.plans.registry import query
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views

CELL_VOLUME = 1.0e9


def rounded(df, digits: int = 6):
    """Doubles to a fixed number of digits, so that the order of a sum does not show; no negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else c for c, t in df.dtypes])


_TENSOR = ", ".join(f"sum(CASE WHEN len > 2.220446049250313e-16 THEN len * ({a[0]}2 - {a[0]}) / len * ({a[1]}2 - {a[1]}) / len ELSE 0 END) AS {a}" for a in metrics.AXES)
_AREA = "pi() * radius * radius"


@query(
    with_views(
        f""", pf AS (SELECT fiber_id, count(*) AS segments, sum(CASE WHEN len > 2.220446049250313e-16 THEN len ELSE 0 END) AS length, {_TENSOR} FROM segs GROUP BY fiber_id),
f AS (SELECT pf.*, fibers.material_id, radius FROM pf JOIN fibers USING (fiber_id)),
m AS (SELECT materials.material_id, name, count(fiber_id) AS fibers, coalesce(sum(segments), 0) AS segments, coalesce(sum(length), 0) AS length, coalesce(sum(length * {_AREA}), 0) AS volume,
  {", ".join(f"coalesce(sum({a}), 0) AS l{a}, coalesce(sum({a} * {_AREA}), 0) AS v{a}" for a in metrics.AXES)}
  FROM materials LEFT JOIN f USING (material_id) GROUP BY 1, 2),
b AS (SELECT 'material' AS level, * EXCLUDE (material_id) FROM m UNION ALL
  SELECT 'total', 'all', sum(fibers), sum(segments), sum(length), sum(volume), {", ".join(f"sum(l{a}), sum(v{a})" for a in metrics.AXES)} FROM m)
SELECT level, name, CAST(fibers AS BIGINT) AS fibers, CAST(segments AS BIGINT) AS segments, round(length, 3) AS length, round(volume, 3) AS volume, round(volume / 1e9, 9) AS volume_fraction,
  {", ".join(f"round(CASE WHEN length > 0 THEN l{a} / length ELSE 0 END, 6) AS length_{a}, round(CASE WHEN volume > 0 THEN v{a} / volume ELSE 0 END, 6) AS volume_{a}" for a in metrics.AXES)} FROM b""",
        "segs", "fibers", "materials",
    )
)
def assembly_metrics(spark, sf_dir):
    out = metrics.assembly_metrics(ad.vertices(spark, sf_dir), ad.fibers(spark, sf_dir), ad.materials(spark, sf_dir), CELL_VOLUME)
    digits = {"length": 3, "volume": 3, "volume_fraction": 9}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    with_views(
        """, e AS (SELECT fiber_id, count(*) AS vertices, min_by(x, seq) AS x0, min_by(y, seq) AS y0, min_by(z, seq) AS z0, max_by(x, seq) AS x1, max_by(y, seq) AS y1, max_by(z, seq) AS z1 FROM vertices GROUP BY 1),
l AS (SELECT fiber_id, count(*) AS segments, sum(len) AS length FROM segs GROUP BY 1)
SELECT e.fiber_id, vertices, coalesce(segments, 0) AS segments, round(coalesce(length, 0), 6) AS length, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2), 6) AS end_to_end,
  round(CASE WHEN length > 0 THEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2) / length ELSE 0 END, 6) AS straightness
FROM e LEFT JOIN l USING (fiber_id)""",
        "segs",
    )
)
def fiber_lengths(spark, sf_dir):
    return rounded(metrics.fiber_lengths(ad.vertices(spark, sf_dir)))


@query(
    with_views(
        f""", t AS (SELECT fiber_id % 4 AS layer, len, (x2 - x) / len AS tx, (y2 - y) / len AS ty, (z2 - z) / len AS tz FROM segs WHERE len > 2.220446049250313e-16)
SELECT CAST(layer AS INTEGER) AS layer, round(sum(len), 3) AS weight, {", ".join(f"round(sum(len * t{a[0]} * t{a[1]}) / sum(len), 6) AS {a}" for a in metrics.AXES)} FROM t GROUP BY 1""",
        "segs",
    )
)
def orientation_by_layer(spark, sf_dir):
    v = ad.vertices(spark, sf_dir)
    t = sg.tangents(sg.segments(v)).withColumn("layer", F.pmod("fiber_id", F.lit(ad.LAYERS)).cast("int"))
    sums = [F.sum(F.col("len") * F.col(f"t{a[0]}") * F.col(f"t{a[1]}")).alias(a) for a in metrics.AXES]
    out = t.groupBy("layer").agg(F.sum("len").alias("weight"), *sums)
    return out.select("layer", F.round("weight", 3).alias("weight"), *[F.round(F.col(a) / F.col("weight"), 6).alias(a) for a in metrics.AXES])


_CURVATURE = """, p AS (SELECT fiber_id, seq, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, lead(z) OVER w - z AS bz
  FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)),
k AS (SELECT fiber_id, seq, CASE WHEN la > 2.220446049250313e-16 AND lb > 2.220446049250313e-16 THEN 2 * sin(acos(least(greatest((ax * bx + ay * by_ + az * bz) / (la * lb), -1), 1)) / 2) / ((la + lb) / 2) END AS curvature
  FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb FROM p WHERE ax IS NOT NULL AND bx IS NOT NULL))
"""


@query(with_views(_CURVATURE + "SELECT fiber_id, seq, round(curvature, 6) AS curvature FROM k", "vertices"))
def vertex_curvature(spark, sf_dir):
    return rounded(sg.vertex_curvature(ad.vertices(spark, sf_dir)))


@query(with_views(_CURVATURE + "SELECT fiber_id, round(coalesce(max(curvature), 0), 6) AS max_curvature FROM (SELECT DISTINCT fiber_id FROM vertices) LEFT JOIN k USING (fiber_id) GROUP BY 1", "vertices"))
def maximum_curvature(spark, sf_dir):
    return rounded(sg.maximum_curvature(ad.vertices(spark, sf_dir)))


@query(with_views(_CURVATURE + "SELECT k.fiber_id, seq, round(curvature * 0.5, 6) AS ratio, curvature * 0.5 > 1 AS violated FROM k WHERE curvature IS NOT NULL", "vertices"))
def curvature_ratio(spark, sf_dir):
    """Curvature against a smallest bend radius of 0.5; a ratio over 1 violates it."""
    k = sg.vertex_curvature(ad.vertices(spark, sf_dir)).where("curvature is not null")
    r = F.col("curvature") * F.lit(0.5)
    return k.select("fiber_id", "seq", F.round(r, 6).alias("ratio"), (r > 1).alias("violated"))


@query(
    with_views(
        """, t AS (SELECT fiber_id, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz
  FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq))
SELECT fiber_id, seq, round(dx / n, 6) + 0.0 AS tx, round(dy / n, 6) + 0.0 AS ty, round(dz / n, 6) + 0.0 AS tz FROM (SELECT *, nullif(sqrt(dx * dx + dy * dy + dz * dz), 0) AS n FROM t)""",
        "vertices",
    )
)
def vertex_tangents(spark, sf_dir):
    return rounded(sg.vertex_tangents(ad.vertices(spark, sf_dir)))


_GRID = ", ".join(f"{i / 10}" for i in range(11))


@query(
    with_views(
        f""", q AS (SELECT fiber_id % 5 AS material_id, count(*) AS count, avg(len) AS mean, stddev_pop(len) AS std, quantile_cont(len, [{_GRID}]) AS quantiles FROM segs WHERE isfinite(len) GROUP BY 1)
SELECT CAST(material_id AS INTEGER) AS material_id, k - 1 AS k, count, round(mean, 6) AS mean, round(std, 6) AS std, round(quantiles[k], 6) AS q FROM q, range(1, 12) r(k)""",
        "segs",
    )
)
def length_distribution(spark, sf_dir):
    s = sg.segments(ad.vertices(spark, sf_dir)).withColumn("material_id", F.pmod("fiber_id", F.lit(ad.MATERIALS)).cast("int"))
    d = distribution.summary(s, "len", 11, ["material_id"])
    return rounded(d.select("material_id", "count", "mean", "std", F.posexplode("quantiles").alias("k", "q")))


@query(
    with_views(
        """, p AS (SELECT i, i / 100.0 AS p FROM range(0, 101) r(i)),
a AS (SELECT quantile_cont(len, [0, %s]) AS q FROM segs WHERE fiber_id %% 2 = 0), b AS (SELECT quantile_cont(len, [0, %s]) AS q FROM segs WHERE fiber_id %% 2 = 1)
SELECT round(sum(abs(a.q[i + 1] - b.q[i + 1]) * CASE WHEN i IN (0, 100) THEN 0.5 ELSE 1 END) / 100, 6) AS distance FROM p, a, b"""
        % ((", ".join(str(i / 100) for i in range(1, 101)),) * 2),
        "segs",
    )
)
def wasserstein_distance(spark, sf_dir):
    s = sg.segments(ad.vertices(spark, sf_dir))
    return rounded(distribution.wasserstein(s.where("fiber_id % 2 = 0"), s.where("fiber_id % 2 = 1"), "len"))


@query(
    with_views(
        """, r AS (SELECT fiber_id, len, row_number() OVER (PARTITION BY fiber_id ORDER BY len) - 1 AS r, count(*) OVER (PARTITION BY fiber_id) AS n FROM segs)
SELECT r.fiber_id, round(greatest(2 * radius, len), 6) AS spacing FROM r JOIN fibers USING (fiber_id) WHERE r = n // 2""",
        "segs", "fibers",
    )
)
def default_spacing(spark, sf_dir):
    """The larger of a fiber's diameter and its upper-median segment."""
    m = distribution.upper_median(sg.segments(ad.vertices(spark, sf_dir)), "len", ["fiber_id"])
    out = ad.with_attributes(m).select("fiber_id", F.greatest(2 * F.col("radius"), F.col("upper_median")).alias("spacing"))
    return rounded(out)


@query(
    with_views(
        """, d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)),
issues AS (
  SELECT 'zero_length_segment' AS code, fiber_id AS id, seq - 1 AS "at" FROM d WHERE x = px AND y = py AND z = pz
  UNION ALL SELECT 'non_finite_point', fiber_id, seq FROM vertices WHERE NOT (isfinite(x) AND isfinite(y) AND isfinite(z))
  UNION ALL SELECT 'too_few_vertices', fiber_id, count(*) FROM vertices GROUP BY 1, 2 HAVING count(*) < 60
  UNION ALL SELECT 'unknown_material', fiber_id, CAST(material_id AS BIGINT) FROM fibers WHERE material_id NOT IN (SELECT material_id FROM materials WHERE material_id < 4)
  UNION ALL SELECT 'section_size', fiber_id, CAST(section_id AS BIGINT) FROM fibers WHERE NOT radius > 0.25)
SELECT code, id, "at" FROM issues""",
        "vertices", "fibers", "materials",
    )
)
def validate_assembly(spark, sf_dir):
    """All issues at once: the fixture knows materials below 4, asks for 60 vertices and radii over 0.25."""
    known = ad.materials(spark, sf_dir).where("material_id < 4")
    return validation.issues(ad.vertices(spark, sf_dir), ad.fibers(spark, sf_dir), known, least_vertices=60, least_radius=0.25)


@query(with_views("SELECT DISTINCT layer FROM fibers", "fibers"))
def layer_ids(spark, sf_dir):
    return ad.fibers(spark, sf_dir).select("layer").distinct()


@query(with_views("SELECT v.* FROM vertices v JOIN fibers USING (fiber_id) WHERE layer = 2", "vertices", "fibers"))
def select_layer(spark, sf_dir):
    keep = ad.fibers(spark, sf_dir).where("layer = 2").select("fiber_id")
    return ad.vertices(spark, sf_dir).join(keep, "fiber_id", "left_semi")


@query(
    with_views(
        """, c AS (SELECT fiber_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vertices GROUP BY 1)
SELECT layer, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM c JOIN fibers USING (fiber_id) GROUP BY 1""",
        "vertices", "fibers",
    )
)
def layer_targets(spark, sf_dir):
    """Mean over a layer's fibers of each fiber's mean vertex."""
    c = ad.vertices(spark, sf_dir).groupBy("fiber_id").agg(*[F.avg(a).alias(a) for a in "xyz"])
    return rounded(ad.with_attributes(c).groupBy("layer").agg(*[F.avg(a).alias(a) for a in "xyz"]))


@query(
    with_views(
        """, b AS (SELECT layer, min(x - radius) AS low, max(x + radius) AS high FROM vertices JOIN fibers USING (fiber_id) GROUP BY 1)
SELECT layer, round(lead(low) OVER (ORDER BY layer) - high, 6) AS clearance FROM b QUALIFY lead(low) OVER (ORDER BY layer) IS NOT NULL""",
        "vertices", "fibers",
    )
)
def layer_clearances(spark, sf_dir):
    """Lower face of the next layer less the upper face of this one."""
    b = ad.with_attributes(ad.vertices(spark, sf_dir)).groupBy("layer").agg(F.min(F.col("x") - F.col("radius")).alias("low"), F.max(F.col("x") + F.col("radius")).alias("high"))
    # one row a layer is left; the next layer is joined by number, so no window over all rows
    n = b.select((F.col("layer") - 1).alias("layer"), F.col("low").alias("next"))
    return rounded(b.join(n, "layer").select("layer", (F.col("next") - F.col("high")).alias("clearance")))


@query(
    with_views(
        "SELECT round(min(x - radius - 0.1), 6) AS x0, round(min(y - radius - 0.1), 6) AS y0, round(min(z - radius - 0.1), 6) AS z0, round(max(x + radius + 0.1), 6) AS x1, round(max(y + radius + 0.1), 6) AS y1, round(max(z + radius + 0.1), 6) AS z1 FROM vertices JOIN fibers USING (fiber_id)",
        "vertices", "fibers",
    )
)
def capsule_bounds(spark, sf_dir):
    v = ad.with_attributes(ad.vertices(spark, sf_dir))
    pad = F.col("radius") + 0.1
    return rounded(v.agg(*[F.min(F.col(c) - pad).alias(f"{c}0") for c in "xyz"], *[F.max(F.col(c) + pad).alias(f"{c}1") for c in "xyz"]))


@query(with_views("SELECT round(sum(pi() * radius * radius * length), 3) AS volume FROM (SELECT fiber_id, sum(len) AS length FROM segs GROUP BY 1) JOIN fibers USING (fiber_id)", "segs", "fibers"))
def nominal_volume(spark, sf_dir):
    length = sg.segments(ad.vertices(spark, sf_dir)).groupBy("fiber_id").agg(F.sum("len").alias("length"))
    f = ad.with_attributes(length)
    return f.agg(F.round(F.sum(F.pi() * F.col("radius") * F.col("radius") * F.col("length")), 3).alias("volume"))


@query(
    with_views(
        """, e AS (SELECT fiber_id, seq = 0 OR seq = max(seq) OVER (PARTITION BY fiber_id) AS tip, x, y FROM vertices),
t AS (SELECT count(*) FILTER (tip AND x BETWEEN 1 AND 40 AND y BETWEEN 24 AND 700) AS interior_ends, count(*) FILTER (tip) AS ends FROM e),
l AS (SELECT sum(len) AS total FROM segs)
SELECT interior_ends, ends, round(2 * total / interior_ends, 6) AS implied_length FROM t, l WHERE interior_ends > 0""",
        "segs",
    )
)
def end_statistics(spark, sf_dir):
    """Fiber ends inside the box, and the length that they imply: 2 x total length / ends."""
    w = Window.partitionBy("fiber_id")
    v = ad.vertices(spark, sf_dir).withColumn("last", F.max("seq").over(w))
    d = [F.lead(c).over(sg.along()) - F.col(c) for c in "xyz"]
    v = v.withColumn("len", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    tip = (F.col("seq") == 0) | (F.col("seq") == F.col("last"))
    inside = tip & F.col("x").between(1, 40) & F.col("y").between(24, 700)
    out = v.agg(F.count_if(inside).alias("interior_ends"), F.count_if(tip).alias("ends"), F.sum("len").alias("total"))
    return out.where("interior_ends > 0").select("interior_ends", "ends", F.round(2 * F.col("total") / F.col("interior_ends"), 6).alias("implied_length"))


@query("SELECT name, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT p_type AS name, min(p_partkey) AS first FROM part GROUP BY 1)")
def intern_names(spark, sf_dir):
    """Dense ids of names in the order in which they first occur."""
    from filamenta.session import table

    return validation.interned(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query(
    with_views(
        "SELECT CAST(layer AS INTEGER) AS layer, CAST(material_id AS INTEGER) AS material_id, count(*) AS fibers, round(sum(length), 3) AS length FROM (SELECT fiber_id, sum(len) AS length FROM segs GROUP BY 1) JOIN fibers USING (fiber_id) GROUP BY GROUPING SETS ((layer, material_id), (layer), ())",
        "segs", "fibers",
    )
)
def rollup_lengths(spark, sf_dir):
    """Counts and lengths by layer and material, by layer, and in total, in one pass."""
    f = ad.with_attributes(sg.segments(ad.vertices(spark, sf_dir)).groupBy("fiber_id").agg(F.sum("len").alias("length")))
    return f.rollup("layer", "material_id").agg(F.count("*").alias("fibers"), F.round(F.sum("length"), 3).alias("length"))
