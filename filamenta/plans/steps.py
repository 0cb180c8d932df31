"""Single steps of the relaxation solver, and reduced metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamenta.operators import contacts, solver
from filamenta.operators import segments as sg
from filamenta.plans.measures import rounded
from filamenta.plans.neighbourhoods import _CONTACTS_GAP, _PAIRS, _WINDOW
from filamenta.plans.registry import query
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views

_INTERNAL = """, p AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz,
  lag(x, 2) OVER w AS cx, lag(y, 2) OVER w AS cy, lag(z, 2) OVER w AS cz, lead(x, 2) OVER w AS ex, lead(y, 2) OVER w AS ey, lead(z, 2) OVER w AS ez FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)),
n AS (SELECT *, nullif(sqrt((ax - x) ** 2 + (ay - y) ** 2 + (az - z) ** 2), 0) AS na, nullif(sqrt((bx - x) ** 2 + (by_ - y) ** 2 + (bz - z) ** 2), 0) AS nb FROM p),
ic AS (SELECT fiber_id, seq, x, y, z, coalesce((ax - x) * 0.25 * (na - 40) / na, 0) + coalesce((bx - x) * 0.25 * (nb - 40) / nb, 0) + coalesce(0.1 * ((cx + ex) / 2 - x), 0) AS dx,
  coalesce((ay - y) * 0.25 * (na - 40) / na, 0) + coalesce((by_ - y) * 0.25 * (nb - 40) / nb, 0) + coalesce(0.1 * ((cy + ey) / 2 - y), 0) AS dy,
  coalesce((az - z) * 0.25 * (na - 40) / na, 0) + coalesce((bz - z) * 0.25 * (nb - 40) / nb, 0) + coalesce(0.1 * ((cz + ez) / 2 - z), 0) AS dz FROM n),
am AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy + dz * dz) > 5 THEN 5 / sqrt(dx * dx + dy * dy + dz * dz) ELSE 1 END AS s FROM ic),
moved AS (SELECT fiber_id, seq, least(greatest(x + dx * s, 0), 150) AS x, y + dy * s AS y, z + dz * s AS z FROM am)
"""


@query(with_views(_INTERNAL + "SELECT fiber_id, seq, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(dz, 6) + 0.0 AS dz FROM ic", "vertices"))
def internal_corrections(spark, sf_dir):
    return rounded(solver.internal_corrections(ad.vertices(spark, sf_dir), 40.0))


def _moved(v):
    return solver.applied(v, solver.internal_corrections(v, 40.0), 5.0, {"x": (0.0, 150.0)})


@query(with_views(_INTERNAL + "SELECT fiber_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM moved", "vertices"))
def apply_internal(spark, sf_dir):
    return rounded(_moved(ad.vertices(spark, sf_dir)))


@query(with_views(_INTERNAL + "SELECT round(max(sqrt((m.x - v.x) ** 2 + (m.y - v.y) ** 2 + (m.z - v.z) ** 2)), 6) AS largest, round(avg(sqrt((m.x - v.x) ** 2 + (m.y - v.y) ** 2 + (m.z - v.z) ** 2)), 6) AS mean FROM vertices v JOIN moved m USING (fiber_id, seq)", "vertices"))
def step_metrics(spark, sf_dir):
    v = ad.vertices(spark, sf_dir)
    return rounded(solver.step_metrics(v, _moved(v)))


_CONTACT = _PAIRS + f""", hit AS (SELECT *, ax + ux * s AS px, ay + uy * s AS py, az + uz * s AS pz, bx + vx * t AS qx, by_ + vy * t AS qy, bz + vz * t AS qz FROM contacts WHERE distance <= {_CONTACTS_GAP}),
pu AS (SELECT *, (px - qx) * ({_CONTACTS_GAP} - distance) / CASE WHEN distance > 1e-9 THEN 2 * distance END AS dx, (py - qy) * ({_CONTACTS_GAP} - distance) / CASE WHEN distance > 1e-9 THEN 2 * distance END AS dy, (pz - qz) * ({_CONTACTS_GAP} - distance) / CASE WHEN distance > 1e-9 THEN 2 * distance END AS dz FROM hit),
sd AS (SELECT fa AS fiber_id, sa AS seq, dx, dy, dz FROM pu UNION ALL SELECT fb, sb, -dx, -dy, -dz FROM pu),
sa AS (SELECT fiber_id, seq, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz FROM sd GROUP BY 1, 2)
"""


@query(with_views(_CONTACT + ", e AS (SELECT fiber_id, seq + unnest([0, 1]) AS seq, dx, dy, dz FROM sa) SELECT fiber_id, seq, round(sum(dx), 6) + 0.0 AS dx, round(sum(dy), 6) + 0.0 AS dy, round(sum(dz), 6) + 0.0 AS dz FROM e GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY e.fiber_id, e.seq"), "segs"))
def contact_corrections(spark, sf_dir):
    """Vertices are moved by the contacts of short segments, which are found and summed once for equal fibers."""
    short = sg.segments(ad.vertices(spark, sf_dir)).where(F.col("len") <= _WINDOW)
    lines, same = contacts.lined(short)
    moved = solver.shared_corrections(contacts.sums(lines, _CONTACTS_GAP))
    out = same.select("fiber_id", "line").join(moved, "line")
    return rounded(out.select("fiber_id", "seq", "dx", "dy", "dz"))


@query(
    with_views(
        """, c AS (SELECT v.fiber_id, layer, avg(x) AS c FROM vertices v JOIN fibers USING (fiber_id) GROUP BY 1, 2), st AS (SELECT fiber_id, least(greatest((20.0 * layer + 30 - c) * 0.3, -2), 2) AS step FROM c)
SELECT fiber_id, seq, round(x + step, 6) AS x FROM vertices JOIN st USING (fiber_id)""",
        "vertices", "fibers",
    )
)
def layer_target_step(spark, sf_dir):
    v = ad.with_attributes(ad.vertices(spark, sf_dir))
    t = v.select("layer").distinct().withColumn("target", 20.0 * F.col("layer") + 30)
    return rounded(solver.towards_layers(v, t, "x", 0.3, 2.0).select("fiber_id", "seq", "x"))


@query(with_views(", c AS (SELECT layer, avg(c) AS c FROM (SELECT fiber_id, avg(x) AS c FROM vertices GROUP BY 1) JOIN fibers USING (fiber_id) GROUP BY 1) SELECT round(max(abs(c - (20.0 * layer + 30))), 6) AS error FROM c", "vertices", "fibers"))
def layer_target_error(spark, sf_dir):
    c = ad.with_attributes(ad.vertices(spark, sf_dir).groupBy("fiber_id").agg(F.avg("x").alias("c"))).groupBy("layer").agg(F.avg("c").alias("c"))
    return rounded(c.agg(F.max(F.abs(F.col("c") - (20.0 * F.col("layer") + 30))).alias("error")))


@query(with_views("SELECT fiber_id, seq, round(x * 0.8, 6) AS x, round(10 + (y - 10) * 1.05, 6) AS y, z FROM vertices", "vertices"))
def affine_compaction(spark, sf_dir):
    return rounded(solver.affine(ad.vertices(spark, sf_dir), {"x": (0.0, 100.0), "y": (10.0, 100.0)}, {"x": (0.0, 80.0), "y": (10.0, 105.0)}))


@query(with_views("SELECT fiber_id, seq, round(x + avg(x) OVER (PARTITION BY fiber_id) * 0.8 - avg(x) OVER (PARTITION BY fiber_id), 9) AS x, y, z FROM vertices", "vertices"))
def rigid_compaction(spark, sf_dir):
    out = solver.rigid_centres(ad.vertices(spark, sf_dir), {"x": (0.0, 100.0)}, {"x": (0.0, 80.0)})
    return out.select("fiber_id", "seq", F.round("x", 9).alias("x"), "y", "z")


@query(with_views("SELECT fiber_id, seq, round(least(greatest(x, 5), 60), 6) AS x, round(abs(x - least(greatest(x, 5), 60)), 6) AS reaction FROM vertices", "vertices"))
def moving_walls(spark, sf_dir):
    return rounded(solver.within_walls(ad.vertices(spark, sf_dir), {"x": (5.0, 60.0)}).select("fiber_id", "seq", "x", "reaction"))


@query(
    with_views(
        """, q AS (SELECT fiber_id, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, z - lag(z) OVER w AS az, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_, lead(z) OVER w - z AS bz FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)),
k AS (SELECT fiber_id, 2 * sin(acos(least(greatest((ax * bx + ay * by_ + az * bz) / (la * lb), -1), 1)) / 2) / ((la + lb) / 2) AS k FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb FROM q WHERE ax IS NOT NULL AND bx IS NOT NULL) WHERE la > 2.220446049250313e-16 AND lb > 2.220446049250313e-16)
SELECT fiber_id, count(*) AS places FROM k WHERE round(k, 6) > 0.1 GROUP BY 1 HAVING count(*) >= 5""",
        "vertices",
    )
)
def refinement_candidates(spark, sf_dir):
    k = sg.vertex_curvature(ad.vertices(spark, sf_dir)).withColumn("ratio", F.round("curvature", 6))
    return solver.marked(k, 0.1, 5)
