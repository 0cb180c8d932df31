"""Bonded particles, capsules, bridges and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import generate, particles
from filamenta.operators import segments as sg
from filamenta.plans.measures import rounded
from filamenta.plans.registry import query
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views

H = 30.0
_XYZ = "round(x + (x2 - x) * t, 6) AS x, round(y + (y2 - y) * t, 6) AS y, round(z + (z2 - z) * t, 6) AS z"


@query(
    with_views(
        f""", n AS (SELECT *, floor(total / {H} + 1e-12) AS n, CASE WHEN floor(total / {H} + 1e-12) >= 1 THEN (total - floor(total / {H} + 1e-12) * {H}) / 2 ELSE total / 2 END AS start FROM arcs WHERE total > 0),
k AS (SELECT *, unnest(range(CAST(greatest(0, ceil((a0 - start) / {H})) AS BIGINT), CAST(CASE WHEN last THEN n + 1 ELSE least(n + 1, ceil((a1 - start) / {H})) END AS BIGINT))) AS k FROM n)
SELECT fiber_id, k, {_XYZ} FROM (SELECT *, least(greatest(coalesce((start + k * {H} - a0) / nullif(len, 0), 0), 0), 1) AS t FROM k)""",
        "arcs",
    )
)
def exact_spheres(spark, sf_dir):
    return rounded(particles.exact_spheres(ad.vertices(spark, sf_dir), H))


_DYNAMIC = f""", p AS (SELECT *, greatest(1, CAST(round(len / {H}) AS INTEGER)) AS parts FROM arcs), dy AS (SELECT *, unnest(range(0, parts + CASE WHEN last THEN 1 ELSE 0 END)) AS j FROM p)
"""


@query(with_views(_DYNAMIC + "SELECT fiber_id, seq, j, round(x + (x2 - x) * j / parts, 6) AS x, round(y + (y2 - y) * j / parts, 6) AS y, round(z + (z2 - z) * j / parts, 6) AS z FROM dy", "arcs"))
def dynamic_spheres(spark, sf_dir):
    return rounded(particles.dynamic_spheres(ad.vertices(spark, sf_dir), H))


@query(with_views(_DYNAMIC + ", n AS (SELECT fiber_id, row_number() OVER (PARTITION BY fiber_id ORDER BY seq, j) - 1 AS a, count(*) OVER (PARTITION BY fiber_id) AS n FROM dy) SELECT fiber_id, a, a + 1 AS b FROM n WHERE a < n - 1", "arcs"))
def consecutive_bonds(spark, sf_dir):
    return particles.consecutive_bonds(particles.dynamic_spheres(ad.vertices(spark, sf_dir), H), ["seq", "j"])


@query(
    with_views(
        f""", n AS (SELECT *, greatest(1, ceil(total / (2 * radius * 8.0))) AS n, total / greatest(1, ceil(total / (2 * radius * 8.0))) AS h FROM arcs JOIN fibers USING (fiber_id) WHERE total > 0),
k AS (SELECT *, unnest(range(CAST(ceil(a0 / h) AS BIGINT), CAST(CASE WHEN last THEN n + 1 ELSE ceil(a1 / h) END AS BIGINT))) AS k FROM n)
SELECT fiber_id, k, {_XYZ} FROM (SELECT *, least(greatest(coalesce((k * h - a0) / nullif(len, 0), 0), 0), 1) AS t FROM k)""",
        "arcs", "fibers",
    )
)
def even_spheres(spark, sf_dir):
    return rounded(particles.even_spheres(ad.vertices(spark, sf_dir), ad.fibers(spark, sf_dir), 8.0))


@query(
    with_views(
        """, w AS (SELECT *, floor(len / 12) AS whole, len - floor(len / 12) * 12 AS rest FROM segs WHERE len > 0), n AS (SELECT *, CAST(CASE WHEN whole < 1 THEN 1 WHEN rest > 3 THEN whole + 1 ELSE whole END AS BIGINT) AS n FROM w)
SELECT fiber_id, seq, j, j * 12.0 AS start, round(CASE WHEN j = n - 1 THEN len - j * 12 ELSE 12 END, 6) AS length FROM (SELECT *, unnest(range(n)) AS j FROM n)""",
        "segs",
    )
)
def constant_capsules(spark, sf_dir):
    return rounded(particles.constant_capsules(ad.vertices(spark, sf_dir), 12.0, 3.0))


@query(
    with_views(
        """, t AS (SELECT s.*, radius, (x2 - x) / len AS tx, (y2 - y) / len AS ty, (z2 - z) / len AS tz FROM segs s JOIN fibers USING (fiber_id) WHERE len > 2.220446049250313e-16), q AS (SELECT *, sqrt(greatest((1 + tz) / 2, 0)) AS w FROM t)
SELECT fiber_id, seq, round((x + x2) / 2, 6) AS cx, round((y + y2) / 2, 6) AS cy, round((z + z2) / 2, 6) AS cz, round(len, 6) AS length, radius,
  round(CASE WHEN w < 1e-9 THEN 0 ELSE w END, 6) AS qw, round(CASE WHEN w < 1e-9 THEN 1 ELSE -ty / (2 * w) END, 6) + 0.0 AS qx, round(CASE WHEN w < 1e-9 THEN 0 ELSE tx / (2 * w) END, 6) + 0.0 AS qy, CAST(0 AS DOUBLE) AS qz FROM q""",
        "segs", "fibers",
    )
)
def fiber_capsules(spark, sf_dir):
    return rounded(particles.capsules(ad.vertices(spark, sf_dir), ad.fibers(spark, sf_dir)))


@query(
    with_views(
        """, i AS (SELECT len, radius, pi() * radius * radius * len AS cyl, 4.0 / 3 * pi() * radius ** 3 AS caps FROM segs JOIN fibers USING (fiber_id)), m AS (SELECT *, 2.0 * cyl / (cyl + caps) AS mc, 2.0 * caps / (cyl + caps) AS mh FROM i)
SELECT radius, round(sum(mc * radius * radius / 2 + mh * 2 * radius * radius / 5), 4) AS along, round(sum(mc * (len * len / 12 + radius * radius / 4) + mh * (2 * radius * radius / 5 + len * len / 4 + 3 * len * radius / 8)), 3) AS across FROM m GROUP BY 1""",
        "segs", "fibers",
    )
)
def capsule_inertia(spark, sf_dir):
    s = ad.with_attributes(sg.segments(ad.vertices(spark, sf_dir)))
    a, b = particles.capsule_inertia(F.lit(2.0), F.col("radius"), F.col("len"))
    return s.groupBy("radius").agg(F.round(F.sum(a), 4).alias("along"), F.round(F.sum(b), 3).alias("across"))


@query(with_views("SELECT fiber_id, seq, round(x - floor(x / 50) * 50, 6) AS x, round(y - floor((y - 10) / 100) * 100, 6) AS y, z, CAST(floor(x / 50) AS BIGINT) AS ix, CAST(floor((y - 10) / 100) AS BIGINT) AS iy FROM vertices", "vertices"))
def wrap_positions(spark, sf_dir):
    return rounded(particles.wrapped(ad.vertices(spark, sf_dir), {"x": 0.0, "y": 10.0}, {"x": 50.0, "y": 100.0}))


@query(
    with_views(
        """, p AS (SELECT fiber_id, seq, x - floor(x / 50) * 50 AS x, y, z FROM vertices), d AS (SELECT *, x - lag(x) OVER w AS dx FROM p WINDOW w AS (PARTITION BY fiber_id ORDER BY seq))
SELECT fiber_id, seq, round(sum(coalesce(dx - 50 * round_even(dx / 50, 0), x)) OVER (PARTITION BY fiber_id ORDER BY seq), 6) AS x, y, z FROM d""",
        "vertices",
    )
)
def unwrap_chains(spark, sf_dir):
    v = ad.vertices(spark, sf_dir).withColumn("x", g.wrap(F.col("x"), 0.0, 50.0))
    return particles.unwrapped(v, {"x": 50.0}).select("fiber_id", "seq", F.round("x", 6).alias("x"), "y", "z")


@query(with_views("SELECT fiber_id, material_id + 1 AS atom_type, section_id * 5 + material_id + 1 AS bond_type FROM fibers", "fibers"))
def fiber_types(spark, sf_dir):
    """Atom and bond types by material and section."""
    return ad.fibers(spark, sf_dir).select("fiber_id", (F.col("material_id") + 1).alias("atom_type"), (F.col("section_id") * 5 + F.col("material_id") + 1).alias("bond_type"))


@query(
    with_views(
        """, a AS (SELECT v.fiber_id // 3 AS junction_id, v.fiber_id % 3 AS idx, x, y, z, radius FROM vertices v JOIN fibers USING (fiber_id) WHERE seq = 3),
b AS (SELECT o.junction_id, o.idx, f.x AS x0, f.y AS y0, f.z AS z0, o.x - f.x AS dx, (o.y - f.y) - 100 * round((o.y - f.y) / 100) AS dy, o.z - f.z AS dz, 0.5 * least(o.radius, f.radius) AS radius FROM a o JOIN a f ON o.junction_id = f.junction_id AND f.idx = 0 AND o.idx > 0)
SELECT CAST(junction_id AS BIGINT) AS junction_id, CAST(idx AS BIGINT) AS idx, round(x0, 6) AS x0, round(y0, 6) AS y0, round(z0, 6) AS z0, round(x0 + dx, 6) AS x1, round(y0 + dy, 6) AS y1, round(z0 + dz, 6) AS z1, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS length, radius FROM b""",
        "vertices", "fibers",
    )
)
def junction_bridges(spark, sf_dir):
    a = ad.with_attributes(ad.vertices(spark, sf_dir).where("seq = 3")).withColumns({"junction_id": F.floor(F.col("fiber_id") / 3), "idx": F.pmod("fiber_id", F.lit(3))})
    return rounded(particles.bridges(a, 0.5, {"y": 100.0}))


@query(
    """WITH r AS (SELECT CAST(r_regionkey AS BIGINT) AS fiber_id, r_regionkey + 0.5 AS i FROM region), d AS (SELECT fiber_id, 1 - 2 * i / 5 AS z, pi() * (1 + sqrt(5)) * i AS a FROM r), u AS (SELECT fiber_id, sqrt(1 - z * z) * cos(a) AS dx, sqrt(1 - z * z) * sin(a) AS dy, z AS dz FROM d)
SELECT fiber_id, seq, round(5 + (2 * seq - 1) * 1.5 * dx, 6) AS x, round(5 + (2 * seq - 1) * 1.5 * dy, 6) AS y, round(5 + (2 * seq - 1) * 1.5 * dz, 6) AS z FROM u, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS seq)"""
)
def generate_point_crossing(spark, sf_dir):
    """Straight fibers through a point, along a Fibonacci sphere."""
    return rounded(generate.point_crossing(spark, 5, 3.0, (5.0, 5.0, 5.0)))


@query(
    """WITH k AS (SELECT CAST(r_regionkey AS BIGINT) AS fiber_id, CAST(unnest(range(0, 13)) AS INTEGER) AS seq FROM region)
SELECT fiber_id, seq, round(seq / 12.0 * 4, 6) AS x, round(0.3 * sin(2 * pi() * seq / 12.0), 6) + 0.0 AS y, round(0.15 * 0.5 * sin(4 * pi() * seq / 12.0), 6) + 0.0 AS z FROM k"""
)
def generate_wavy_fibers(spark, sf_dir):
    """Wavy centrelines: x = c L, y = A sin 2 pi c, z = A h / 2 sin 4 pi c."""
    return rounded(generate.wavy(spark, 5, 12, 4.0, 0.3, 0.5))


@query("SELECT CAST(f AS BIGINT) AS fiber_id, CAST(s AS INTEGER) AS seq, round((2 * s - 1) * 2.0 * cos(f * 0.7), 6) AS x, round((2 * s - 1) * 2.0 * sin(f * 0.7), 6) + 0.0 AS y, round(f * 0.25, 6) AS z FROM range(0, 2) a(f), range(0, 2) b(s)")
def generate_pair_crossing(spark, sf_dir):
    """Two fibers that cross at an angle, offset along z."""
    return rounded(generate.pair_crossing(spark, 4.0, 0.7, 0.25))
