"""Fiber tables over the relational test tables, the same in Spark and in SQL.

vertices: users of ``events`` are fibers; a vertex is (value, hours since 2024, length of the event type).
fibers, materials, sections: integer rules over the fiber id. image: ``embeddings`` as rows of pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filamenta.session import table

MATERIALS, SECTIONS, LAYERS = 5, 7, 4


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fiber_id, seq, x, y, z), seq from 0."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3.6e9)
    return e.select(
        F.col("user_id").alias("fiber_id"),
        (F.row_number().over(order) - 1).alias("seq"),
        F.col("value").alias("x"),
        hours.alias("y"),
        F.length("event_type").cast("double").alias("z"),
    )


def fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fiber_id, material_id, section_id, layer, radius): one row per fiber."""
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("fiber_id")).distinct()
    return with_attributes(ids)


def with_attributes(rows: DataFrame) -> DataFrame:
    """Material, section, layer and radius by fiber_id."""
    f = F.col("fiber_id")
    return rows.withColumns(
        {
            "material_id": F.pmod(f, F.lit(MATERIALS)).cast("int"),
            "section_id": F.pmod(f, F.lit(SECTIONS)).cast("int"),
            "layer": F.pmod(f, F.lit(LAYERS)).cast("int"),
            "radius": 0.25 * (F.pmod(f, F.lit(SECTIONS)) + 1),
        }
    )


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(material_id, name)."""
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("material_id"), F.col("r_name").alias("name"))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, v): pixels of a two-dimensional slice."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("row", "col", F.col("v").cast("double").alias("v"))


VIEWS = {
    "vertices": """SELECT user_id AS fiber_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value AS x,
  (epoch_us(ts) - 1704067200000000) / 3.6e9 AS y, CAST(length(event_type) AS DOUBLE) AS z FROM events""",
    "fibers": "SELECT DISTINCT user_id AS fiber_id, CAST(user_id % 5 AS INTEGER) AS material_id, CAST(user_id % 7 AS INTEGER) AS section_id, CAST(user_id % 4 AS INTEGER) AS layer, 0.25 * (user_id % 7 + 1) AS radius FROM events",
    "materials": "SELECT CAST(r_regionkey AS INTEGER) AS material_id, r_name AS name FROM region",
    "segs": """SELECT * FROM (SELECT fiber_id, seq, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2,
  sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y) + (lead(z) OVER w - z) * (lead(z) OVER w - z)) AS len
  FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)) WHERE x2 IS NOT NULL""",
    "arcs": """SELECT fiber_id, seq, x, y, z, x2, y2, z2, len, sum(len) OVER (PARTITION BY fiber_id ORDER BY seq) - len AS a0, sum(len) OVER (PARTITION BY fiber_id ORDER BY seq) AS a1,
  sum(len) OVER (PARTITION BY fiber_id) AS total, seq = max(seq) OVER (PARTITION BY fiber_id) AS last FROM segs""",
    "image": "SELECT vec_id AS row, unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
}
NEEDS = {"segs": ["vertices"], "arcs": ["vertices", "segs"]}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views before it; body may start with further common tables (``, name AS (...)``) or a SELECT."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + "\n" + body
