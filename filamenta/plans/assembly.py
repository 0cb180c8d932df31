"""Fibers added to an assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from filamenta.operators import assembly
from filamenta.plans.measures import rounded
from filamenta.plans.registry import query
from filamenta.session import table
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views

#: A batch made of the fibers themselves: every ninth keeps its id, materials run to 5 and sections to 7, which are unknown, and of every seventh a vertex is not placed.
OFFSET = 1_000_000_000
_NEW = f""", nw AS (SELECT CASE WHEN fiber_id % 9 = 0 THEN fiber_id ELSE fiber_id + {OFFSET} END AS fiber_id, CAST(fiber_id % 6 AS INTEGER) AS material_id, CAST(fiber_id % 8 AS INTEGER) AS section_id FROM fibers),
pl AS (SELECT CASE WHEN fiber_id % 9 = 0 THEN fiber_id ELSE fiber_id + {OFFSET} END AS id, fiber_id, seq, x, y, z FROM vertices), nr AS (SELECT id AS fiber_id, count(*) AS n FROM pl GROUP BY 1),
np AS (SELECT id AS fiber_id, count(*) AS n FROM pl WHERE NOT (fiber_id % 7 = 3 AND seq = 1) GROUP BY 1),
ft AS (SELECT nw.*, CASE WHEN coalesce(nr.n, 0) <> coalesce(np.n, 0) THEN 'geometry_length_mismatch' WHEN coalesce(nr.n, 0) < 2 THEN 'too_few_vertices' WHEN nw.fiber_id IN (SELECT fiber_id FROM fibers) THEN 'duplicate_fiber_id'
  WHEN material_id NOT IN (SELECT r_regionkey FROM region) THEN 'unknown_material' WHEN section_id >= 7 THEN 'unknown_section' END AS fault FROM nw LEFT JOIN nr USING (fiber_id) LEFT JOIN np USING (fiber_id))
"""


def _batch(spark, sf_dir):
    f, v = ad.fibers(spark, sf_dir), ad.vertices(spark, sf_dir)
    of = F.when(F.col("fiber_id") % 9 == 0, F.col("fiber_id")).otherwise(F.col("fiber_id") + OFFSET)
    new = f.select(of.alias("fiber_id"), (F.col("fiber_id") % 6).cast("int").alias("material_id"), (F.col("fiber_id") % 8).cast("int").alias("section_id"))
    lines = v.select(of.alias("fiber_id"), "seq", "x", "y", "z", F.col("fiber_id").alias("own"))
    placed = lines.where("not (own % 7 = 3 and seq = 1)")
    materials = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("material_id"))
    sections = f.select("section_id").distinct()
    old = v.select("fiber_id", "seq", *[F.col(c).alias(f"r{c}") for c in "xyz"], "x", "y", "z")
    return assembly.add_fibers(f, old, new, lines.drop("own"), placed.drop("own"), materials, sections)


@query(with_views(_NEW + "SELECT fiber_id, material_id, section_id, fault FROM ft WHERE fault IS NOT NULL", "vertices", "fibers"))
def refused_fibers(spark, sf_dir):
    """Fibers of a batch that an assembly does not take, and why."""
    return _batch(spark, sf_dir)[2]


@query(
    with_views(
        _NEW + """, al AS (SELECT fiber_id, material_id FROM fibers UNION ALL SELECT fiber_id, material_id FROM ft WHERE fault IS NULL), vs AS (SELECT fiber_id, x, y, z FROM vertices UNION ALL SELECT id, x, y, z FROM pl WHERE id IN (SELECT fiber_id FROM ft WHERE fault IS NULL))
SELECT material_id, count(DISTINCT fiber_id) AS fibers, count(*) AS vertices, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM al JOIN vs USING (fiber_id) GROUP BY 1""",
        "vertices", "fibers",
    )
)
def added_fibers(spark, sf_dir):
    """The assembly with the fibers of a batch that pass, by material."""
    fibers, vertices, _ = _batch(spark, sf_dir)
    lines = vertices.groupBy("fiber_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"])
    joined = fibers.join(lines, "fiber_id").groupBy("material_id")
    return rounded(joined.agg(F.count("*").alias("fibers"), F.sum("n").alias("vertices"), *[(F.sum(f"s{c}") / F.sum("n")).alias(c) for c in "xyz"]))
