"""Sections, selections, cell indexes, rankings, set operations and small array functions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import segments as sg
from filamenta.plans.measures import rounded
from filamenta.plans.registry import query
from filamenta.session import table
from filamenta.sources import adapters as ad
from filamenta.sources.adapters import with_views


@query(with_views("SELECT fiber_id, round(pi() * radius * radius * 0.8, 6) AS area, radius AS bounding, round(sqrt(radius * radius * 0.8), 6) AS equivalent, false AS circular FROM fibers", "fibers"))
def section_measures(spark, sf_dir):
    """Elliptical sections with semi-axes r and 0.8 r: area, largest half-width, equivalent radius."""
    a, b = F.col("radius"), 0.8 * F.col("radius")
    return rounded(ad.fibers(spark, sf_dir).select("fiber_id", (F.lit(math.pi) * a * b).alias("area"), F.greatest(a, b).alias("bounding"), F.sqrt(a * b).alias("equivalent"), (a == b).alias("circular")))


@query(with_views("SELECT fiber_id, seq, round(10 + 0.6 * x - 0.8 * y, 6) + 0.0 AS x, round(-5 + 0.8 * x + 0.6 * y, 6) + 0.0 AS y, z + 2 AS z FROM vertices", "vertices"))
def transform_points(spark, sf_dir):
    """A rotation about z and a translation."""
    v = ad.vertices(spark, sf_dir)
    return rounded(v.select("fiber_id", "seq", (10 + 0.6 * F.col("x") - 0.8 * F.col("y")).alias("x"), (-5 + 0.8 * F.col("x") + 0.6 * F.col("y")).alias("y"), (F.col("z") + 2).alias("z")))


@query(
    with_views(
        "SELECT v.fiber_id, seq, round((x - 20) - 50 * round((x - 20) / 50), 6) + 0.0 AS dx, round((y - 300) - 200 * round((y - 300) / 200), 6) + 0.0 AS dy FROM vertices v", "vertices"
    )
)
def minimum_image_offsets(spark, sf_dir):
    v = ad.vertices(spark, sf_dir)
    return rounded(v.select("fiber_id", "seq", g.minimum_image(F.col("x") - 20, 50.0).alias("dx"), g.minimum_image(F.col("y") - 300, 200.0).alias("dy")))


_CELLS = ", c AS (SELECT fiber_id, seq, CAST(floor((x + x2) / 2 / 10) AS BIGINT) AS cx, CAST(floor((y + y2) / 2 / 50) AS BIGINT) AS cy FROM segs)\n"


def _cells(spark, sf_dir):
    s = sg.segments(ad.vertices(spark, sf_dir))
    return s.select("fiber_id", "seq", F.floor((F.col("x") + F.col("x2")) / 2 / 10).alias("cx"), F.floor((F.col("y") + F.col("y2")) / 2 / 50).alias("cy"))


@query(with_views(_CELLS + ", n AS (SELECT cx, cy, count(*) AS n FROM c GROUP BY 1, 2) SELECT cx, cy, n, CAST(sum(n) OVER (ORDER BY cx, cy) - n AS BIGINT) AS first FROM n", "segs").replace(")\n, n AS", "),\nn AS"))
def cell_offsets(spark, sf_dir):
    """Counts per cell and their exclusive prefix sums: the scan adds totals of columns of cells, then sums inside a column."""
    n = _cells(spark, sf_dir).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    columns = n.groupBy("cx").agg(F.sum("n").alias("all"))
    before = columns.withColumn("before", F.sum("all").over(Window.orderBy("cx")) - F.col("all")).select("cx", "before")
    inside = F.sum("n").over(Window.partitionBy("cx").orderBy("cy")) - F.col("n")
    return n.join(before, "cx").select("cx", "cy", "n", (F.col("before") + inside).alias("first"))


@query(with_views(_CELLS + "SELECT fiber_id, seq, cx, cy, row_number() OVER (PARTITION BY cx, cy ORDER BY fiber_id, seq) - 1 AS rank FROM c", "segs"))
def cell_ranks(spark, sf_dir):
    w = Window.partitionBy("cx", "cy").orderBy("fiber_id", "seq")
    return _cells(spark, sf_dir).withColumn("rank", F.row_number().over(w) - 1)


@query(with_views("SELECT a.fiber_id, a.seq, b.seq AS other, round(b.a0 - a.a1, 6) + 0.0 AS gap FROM arcs a JOIN arcs b ON a.fiber_id = b.fiber_id AND b.seq IN (a.seq + 2, a.seq + 3)", "arcs"))
def along_fiber_gaps(spark, sf_dir):
    """Arc gap between segments of one fiber that are two or three apart."""
    w = sg.along()
    a = sg.arcs(ad.vertices(spark, sf_dir))
    later = F.array(*[F.struct(F.lead("seq", n).over(w).alias("other"), F.lead("a0", n).over(w).alias("b0")) for n in (2, 3)])
    e = a.withColumn("l", later).withColumn("l", F.explode("l")).where("l.other is not null")
    return rounded(e.select("fiber_id", "seq", "l.other", (F.col("l.b0") - F.col("a1")).alias("gap")))


@query(with_views("SELECT fiber_id, seq, round(length_before, 6) AS arc, round(length_before / nullif(total, 0), 6) AS fraction FROM (SELECT fiber_id, seq, a0 AS length_before, total FROM arcs)", "arcs"))
def arc_fractions(spark, sf_dir):
    a = sg.arcs(ad.vertices(spark, sf_dir))
    return rounded(a.select("fiber_id", "seq", F.col("a0").alias("arc"), g.ratio(F.col("a0"), F.col("total")).alias("fraction")))


@query(
    with_views(
        ", k AS (SELECT unnest([0.5, 1.0, 1.6]) AS d) SELECT fiber_id, arg_min(CAST(d AS DOUBLE), struct_pack(e := round(abs(ln(2 * radius) - ln(d)), 9), d := d)) AS diameter FROM fibers, k GROUP BY 1", "fibers"
    )
)
def assign_by_size(spark, sf_dir):
    """Nearest known diameter in log space."""
    kinds = F.array(*[F.struct(F.round(F.abs(F.ln(2 * F.col("radius")) - math.log(d)), 9).alias("e"), F.lit(d).alias("d")) for d in (0.5, 1.0, 1.6)])
    return ad.fibers(spark, sf_dir).select("fiber_id", F.array_min(kinds)["d"].alias("diameter"))


@query(with_views("SELECT name FROM materials WHERE name NOT IN (SELECT DISTINCT name FROM fibers JOIN materials USING (material_id) WHERE layer = 1)", "materials", "fibers"))
def unmatched_names(spark, sf_dir):
    used = ad.fibers(spark, sf_dir).where("layer = 1").join(ad.materials(spark, sf_dir), "material_id").select("name")
    return ad.materials(spark, sf_dir).join(used, "name", "left_anti").select("name")


_BONDS = ", b AS (SELECT CAST(least(l_suppkey, l_partkey % 100 + 1) AS BIGINT) AS a, CAST(greatest(l_suppkey, l_partkey % 100 + 1) AS BIGINT) AS b, l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem)\n"


def _bonds(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_suppkey"), F.pmod("l_partkey", F.lit(100)) + 1
    return t.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("l_quantity").alias("q"))


@query("WITH" + _BONDS[1:] + "SELECT a, b, min(q) AS best, count(*) AS seen FROM b WHERE a <> b GROUP BY 1, 2".replace("GROUP BY 1, 2", "GROUP BY b.a, b.b"))
def merged_bonds(spark, sf_dir):
    """Bonds by unordered pair, once each, with the smallest distance."""
    return _bonds(spark, sf_dir).where("a <> b").groupBy("a", "b").agg(F.min("q").alias("best"), F.count("*").alias("seen"))


@query("WITH" + _BONDS[1:] + ", c AS (SELECT a, b, count(*) AS n FROM b WHERE a <> b GROUP BY 1, 2) SELECT n AS bonds, count(*) AS pairs FROM c GROUP BY 1".replace("FROM b WHERE a <> b GROUP BY 1, 2", "FROM b WHERE a <> b GROUP BY b.a, b.b"))
def pair_bond_counts(spark, sf_dir):
    """How many fiber pairs have 1, 2, ... junctions."""
    n = _bonds(spark, sf_dir).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("bonds"))
    return n.groupBy("bonds").agg(F.count("*").alias("pairs"))


@query(with_views(", p AS (SELECT f.fiber_id AS a, h.fiber_id AS b, f.material_id AS ma, h.material_id AS mb FROM fibers f JOIN fibers h ON f.layer = h.layer AND f.section_id = h.section_id AND f.fiber_id < h.fiber_id) SELECT a, b FROM p WHERE (least(ma, mb), greatest(ma, mb)) IN ((0, 1), (2, 2), (1, 4))", "fibers"))
def allowed_pairs(spark, sf_dir):
    """Fiber pairs of one layer and section whose unordered material pair is allowed: joined on the material that each allows."""
    f = ad.fibers(spark, sf_dir)
    h = f.select(F.col("fiber_id").alias("b"), F.col("material_id").alias("other"), "layer", "section_id")
    allowed = spark.createDataFrame([(a, b) for p in ((0, 1), (2, 2), (1, 4)) for a, b in {p, p[::-1]}], "material_id int, other int")
    asked = f.join(F.broadcast(allowed), "material_id")  # five rows
    return asked.join(h, ["layer", "section_id", "other"]).where("fiber_id < b").select(F.col("fiber_id").alias("a"), "b")


@query(with_views(", a AS (SELECT fiber_id, sum(len) AS length FROM segs GROUP BY 1) SELECT fiber_id, round(length, 6) AS length, 1 + count(*) OVER (ORDER BY round(length, 6) DESC, fiber_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rank FROM a QUALIFY rank <= 20", "segs"))
def longest_fibers(spark, sf_dir):
    """The twenty longest fibers: a top-k report."""
    a = sg.segments(ad.vertices(spark, sf_dir)).groupBy("fiber_id").agg(F.round(F.sum("len"), 6).alias("length"))
    top = a.orderBy(F.desc("length"), "fiber_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("length"), "fiber_id")).cast("long"))


@query(with_views("SELECT fiber_id, seq, x, y, z FROM vertices UNION ALL SELECT fiber_id + 1000000000, seq, x, y, z FROM vertices", "vertices"))
def extend_collection(spark, sf_dir):
    """A collection and a copy of it under ids of its own."""
    v = ad.vertices(spark, sf_dir)
    return v.unionByName(v.withColumn("fiber_id", F.col("fiber_id") + 1000000000))


@query(with_views("SELECT DISTINCT fiber_id FROM vertices EXCEPT SELECT fiber_id FROM vertices WHERE x < 5 GROUP BY 1 HAVING count(*) >= 6", "vertices"))
def lost_fibers(spark, sf_dir):
    """Fibers without enough covered vertices."""
    v = ad.vertices(spark, sf_dir)
    covered = v.where("x < 5").groupBy("fiber_id").agg(F.count("*").alias("n")).where("n >= 6")
    return v.select("fiber_id").distinct().join(covered, "fiber_id", "left_anti")


@query(with_views(", s AS (SELECT fiber_id, count(*) AS n, avg(x) AS support FROM vertices GROUP BY 1), l AS (SELECT fiber_id, sum(len) AS length FROM segs GROUP BY 1) SELECT fiber_id, round(length, 6) AS length, round(support, 6) AS support FROM s JOIN l USING (fiber_id) WHERE length >= 2000 AND support >= 45", "segs"))
def supported_fibers(spark, sf_dir):
    """Fibers that are long enough and well enough supported by the image along them."""
    v = ad.vertices(spark, sf_dir)
    w = sg.along()
    d = [F.lead(c).over(w) - F.col(c) for c in "xyz"]
    s = v.withColumn("len", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).groupBy("fiber_id").agg(F.sum("len").alias("length"), F.avg("x").alias("support"))
    return rounded(s.where("length >= 2000 AND support >= 45"))


@query("SELECT vec_id, CAST(r AS DOUBLE) AS r, round(CAST(embedding[CAST(floor(r) AS INTEGER) + 1] AS DOUBLE) * (1 - r + floor(r)) + CAST(embedding[least(CAST(floor(r) AS INTEGER) + 2, len(embedding))] AS DOUBLE) * (r - floor(r)), 6) + 0.0 AS value FROM embeddings, (SELECT CAST(unnest([0.25, 7.5, 62.9]) AS DOUBLE) AS r)")
def profile_values(spark, sf_dir):
    """Linear interpolation in each row's profile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(*[F.lit(r) for r in (0.25, 7.5, 62.9)])).alias("r"))
    k = F.floor("r").cast("int")
    a, b = F.element_at("embedding", k + 1).cast("double"), F.element_at("embedding", F.least(k + 2, F.size("embedding"))).cast("double")
    f = F.col("r") - F.floor("r")
    return rounded(e.select("vec_id", "r", (a * (1 - f) + b * f).alias("value")))


@query("SELECT label, round(sum((CAST(v AS DOUBLE) - 0.02) ** 2), 4) AS residual, count(*) AS pixels FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1")
def squared_residuals(spark, sf_dir):
    """Sum of squared differences from a constant rendering, by label: arrays are summed in place, without exploding them."""
    e = table(spark, sf_dir, "embeddings")
    s = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + (v.cast("double") - 0.02) * (v.cast("double") - 0.02))
    return e.groupBy("label").agg(F.round(F.sum(s), 4).alias("residual"), F.sum(F.size("embedding")).alias("pixels"))


@query("SELECT l_returnflag AS code, l_linestatus AS status, l_linenumber AS k, round(1 / (sum(l_quantity) + 1), 12) AS weight FROM lineitem GROUP BY 1, 2, 3")
def inverse_work_weights(spark, sf_dir):
    """Weights 1 / (work + floor) by axis."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("code"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("k"))
    return rounded(t.agg((1 / (F.sum("l_quantity") + 1)).alias("weight")), 12)


@query(
    with_views(
        """, p AS (SELECT fiber_id, seq, x - lag(x, 3) OVER w AS ax, y - lag(y, 3) OVER w AS ay, z - lag(z, 3) OVER w AS az, lead(x, 3) OVER w - x AS bx, lead(y, 3) OVER w - y AS by_, lead(z, 3) OVER w - z AS bz FROM vertices WINDOW w AS (PARTITION BY fiber_id ORDER BY seq)),
k AS (SELECT fiber_id, seq, round(atan2(sqrt((ay * bz - az * by_) ** 2 + (az * bx - ax * bz) ** 2 + (ax * by_ - ay * bx) ** 2), ax * bx + ay * by_ + az * bz), 6) AS turn FROM p WHERE ax IS NOT NULL AND bx IS NOT NULL)
SELECT fiber_id, arg_max(seq, struct_pack(t := turn, s := -seq)) AS seq, max(turn) AS turn FROM k GROUP BY 1""",
        "vertices",
    )
)
def worst_kinks(spark, sf_dir):
    """The node of each fiber with the largest turn over three nodes on either side; the first of equal ones."""
    w = sg.along()
    p = ad.vertices(spark, sf_dir).withColumns({f"{k}{c}": (F.col(c) - F.lag(c, 3).over(w)) if k == "a" else (F.lead(c, 3).over(w) - F.col(c)) for c in "xyz" for k in "ab"}).where("ax is not null and bx is not null")
    t = p.select("fiber_id", "seq", F.round(g.angle(g.vec("a"), g.vec("b")), 6).alias("turn"))
    best = t.groupBy("fiber_id").agg(F.max(F.struct("turn", -F.col("seq"), "seq")).alias("b"))
    return best.select("fiber_id", "b.seq", "b.turn")


@query(
    with_views(
        """, m AS (SELECT fiber_id, seq, avg(x) OVER (PARTITION BY fiber_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m, seq AS s, max(seq) OVER (PARTITION BY fiber_id) AS last FROM vertices)
SELECT fiber_id, arg_min(seq, struct_pack(m := round(m, 6), s := seq)) AS cut, min(round(m, 6)) AS mean FROM m WHERE seq >= 5 AND seq <= last - 5 GROUP BY 1""",
        "vertices",
    )
)
def weakest_nodes(spark, sf_dir):
    """Where to cut an over-long fiber: the lowest three-node mean away from both ends."""
    w = sg.along()
    v = ad.vertices(spark, sf_dir).withColumns({"m": F.avg("x").over(w.rowsBetween(-1, 1)), "last": F.max("seq").over(Window.partitionBy("fiber_id"))})
    best = v.where("seq >= 5 AND seq <= last - 5").groupBy("fiber_id").agg(F.min(F.struct(F.round("m", 6).alias("m"), "seq")).alias("b"))
    return best.select("fiber_id", F.col("b.seq").alias("cut"), F.col("b.m").alias("mean"))


@query(
    with_views(
        ", e AS (SELECT fiber_id, seq, len, fiber_id % 3 = 0 AS wake FROM segs) SELECT fiber_id, seq, NOT (fiber_id % 4 > 2) AND (wake OR seq % 2 = 0) AS active, CASE WHEN NOT (fiber_id % 4 > 2) AND (wake OR seq % 2 = 0) THEN row_number() OVER (PARTITION BY fiber_id, NOT (fiber_id % 4 > 2) AND (wake OR seq % 2 = 0) ORDER BY seq) - 1 END AS slot FROM e", "segs"
    )
)
def activate_steps(spark, sf_dir):
    """Fibers of a later step sleep; the active segments of others get dense numbers within their fiber."""
    s = sg.segments(ad.vertices(spark, sf_dir)).select("fiber_id", "seq")
    active = ~(F.pmod("fiber_id", F.lit(4)) > 2) & ((F.pmod("fiber_id", F.lit(3)) == 0) | (F.pmod("seq", F.lit(2)) == 0))
    w = Window.partitionBy("fiber_id", "active").orderBy("seq")
    return s.withColumn("active", active).withColumn("slot", F.when(F.col("active"), F.row_number().over(w) - 1))


@query(
    """WITH e AS (SELECT event_type, CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS slot, value FROM events) SELECT event_type, slot, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY 1, 2"""
)
def windowed_events(spark, sf_dir):
    """Six-hour windows of the event log; ``streaming.vertices`` does the same on a stream."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.groupBy("event_type", F.floor(us / F.lit(21_600_000_000)).alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
