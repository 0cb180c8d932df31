"""Fibers as tables and files of other programs: CSV, VTK polylines, and text in order.

Ids in files run from 0 or 1 without a gap, which ``numbering`` gives from counts by range. Lines are made by executors and
dealt by range of their place, so a folder's parts, in the order of their names, are the file; Spark's commit makes the
folder appear whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import axes
from filamenta.operators import segments as sg
from filamenta.operators.numbering import numbered
from filamenta.session import staged


def write_ordered(lines: DataFrame, path: str) -> None:
    """Text lines (part, n, value) in the order of part and n."""
    lines.select("part", F.col("n").cast("long").alias("n"), "value").repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("value").write.text(path)


def _fixed(spark: SparkSession, part: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, n long, value string")


def fiber_rows(vertices: DataFrame, fibers: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """One row a fiber: number, type, diameter, length, straightness, angles, whether it touches the box's edge, and both ends.

    ``fibers``: fiber_id, type, radius. Fibers are numbered from 1 in the order of their ids, types from 1. The out-of-plane
    angle is that of the fiber's axis with the plane z = 0, the in-plane one its direction there from 0 to 180 degrees. A fiber touches the edge if an end is nearer than 1.5 radii, or 2, to it.
    """
    lengths = sg.segments(vertices).groupBy("fiber_id").agg(F.sum("len").alias("length"))
    tip = lambda f: f(F.struct("x", "y", "z"), "seq")
    ends = vertices.groupBy("fiber_id").agg(tip(F.min_by).alias("a"), tip(F.max_by).alias("b"))
    rows = numbered(ends.join(fibers, "fiber_id").join(lengths, "fiber_id", "left").join(axes.fiber_axes(vertices), "fiber_id"), ["fiber_id"], "number")
    d = tuple(F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz")
    chord, length = g.norm(d), F.coalesce("length", F.lit(0.0))
    margin = F.greatest(1.5 * F.col("radius"), F.lit(2.0))
    edge = F.lit(False)
    for c, lo, hi in zip("xyz", low, high, strict=True):
        for e in "ab":
            edge |= (F.col(f"{e}.{c}") < lo + margin) | (F.col(f"{e}.{c}") > hi - margin)
    sine, turn = F.abs("az"), F.degrees(F.atan2("ay", "ax"))
    return rows.select(
        (F.col("number") + 1).alias("fiber"), (F.col("type") + 1).alias("type"), (2 * F.col("radius")).alias("diameter"), length.alias("length"),
        F.when(length > 0, chord / length).otherwise(1.0).alias("straightness"), F.degrees(F.asin(F.least(sine, F.lit(1.0)))).alias("out_of_plane"), F.pmod(turn, F.lit(180.0)).alias("in_plane"),
        edge.cast("int").alias("touches_edge"), *[F.col(f"{e}.{c}").alias(f"{n}_{c}") for e, n in (("a", "start"), ("b", "end")) for c in "xyz"],
    )


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV parts with a header each, in the order of the columns."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def write_tables(vertices: DataFrame, fibers: DataFrame, folder: str, low: tuple[float, float, float], high: tuple[float, float, float], bonds: DataFrame | None = None) -> None:
    """fibers, centerlines and, where given, bonds (a, b, x, y, z, voxels), as CSV folders under ``folder``."""
    write_csv(fiber_rows(vertices, fibers, low, high), f"{folder}/fibers", ["fiber"])
    numbers = numbered(vertices.select("fiber_id").distinct(), ["fiber_id"], "number").select("fiber_id", (F.col("number") + 1).alias("fiber"))
    write_csv(vertices.join(numbers, "fiber_id").select("fiber", (F.col("seq") + 1).alias("point"), "x", "y", "z"), f"{folder}/centerlines", ["fiber", "point"])
    if bonds is not None:
        side = lambda c: numbers.select(F.col("fiber_id").alias(c), F.col("fiber").alias(f"fiber_{c}"))
        write_csv(bonds.join(side("a"), "a").join(side("b"), "b").select("fiber_a", "fiber_b", "x", "y", "z", "voxels"), f"{folder}/bonds", ["fiber_a", "fiber_b"])


def write_vtk(vertices: DataFrame, fibers: DataFrame, path: str, title: str = "fibers") -> None:
    """Polylines of a legacy VTK file: points, lines, and number, type and diameter of each line. ``fibers``: fiber_id, type, radius."""
    spark = vertices.sparkSession
    points = staged(numbered(vertices.select("fiber_id", "seq", "x", "y", "z"), ["fiber_id", "seq"], "n"), "vtk-points")
    lines = points.groupBy("fiber_id").agg(F.min("n").alias("start"), F.count("*").alias("size")).join(fibers.select("fiber_id", "type", "radius"), "fiber_id")
    lines = staged(numbered(lines, ["fiber_id"], "k"), "vtk-lines")
    n, m = points.count(), lines.count()
    head = ["# vtk DataFile Version 3.0", title, "ASCII", "DATASET POLYDATA", f"POINTS {n} double"]
    text = lambda c: F.col(c).cast("string")
    parts = [_fixed(spark, 0, head), points.select(F.lit(1).alias("part"), "n", F.concat_ws(" ", *[text(c) for c in "xyz"]).alias("value")), _fixed(spark, 2, [f"LINES {m} {n + m}"])]
    listed = F.concat_ws(" ", text("size"), F.array_join(F.transform(F.sequence("start", F.col("start") + F.col("size") - 1), lambda i: i.cast("string")), " "))
    parts.append(lines.select(F.lit(3).alias("part"), F.col("k").alias("n"), listed.alias("value")))
    facts = [("fiber", "int", (F.col("k") + 1).cast("string")), ("type", "int", (F.col("type") + 1).cast("string")), ("diameter", "double", (2 * F.col("radius")).cast("string"))]
    for i, (name, kind, value) in enumerate(facts):
        parts.append(_fixed(spark, 4 + 2 * i, [*([f"CELL_DATA {m}"] if i == 0 else []), f"SCALARS {name} {kind} 1", "LOOKUP_TABLE default"]))
        parts.append(lines.select(F.lit(5 + 2 * i).alias("part"), F.col("k").alias("n"), value.alias("value")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    write_ordered(every, path)


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, fibers) of a file or folder that ``write_vtk`` made: fiber_id counts lines from 0; fibers: fiber_id, type, diameter."""
    from filamenta.sources.lammps import _lines, _place

    rows = _lines(spark, path).where("line <> ''")
    marks = rows.where(F.col("line").rlike(r"^(POINTS|LINES|CELL_DATA|SCALARS|LOOKUP_TABLE) ")).orderBy("at").collect()

    def section(name: str) -> DataFrame:
        k = next(i for i, r in enumerate(marks) if r["line"].startswith(name))
        k += name.startswith("SCALARS")  # the values come after the look-up table's line
        out = rows.where(F.col("at") > _place(marks[k]["at"]))
        out = out.where(F.col("at") < _place(marks[k + 1]["at"])) if k + 1 < len(marks) else out
        return numbered(out.select("at", F.split("line", " ").alias("p")), ["at"], "n")

    points = section("POINTS").select("n", *[F.col("p")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    lines = section("LINES").select(F.col("n").alias("fiber_id"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("seq", "n")).withColumn("n", F.col("n").cast("long"))
    value = lambda name, kind: section(f"SCALARS {name} ").select(F.col("n").alias("fiber_id"), F.col("p")[0].cast(kind).alias(name))
    fibers = value("type", "int").withColumn("type", F.col("type") - 1).join(value("diameter", "double"), "fiber_id")
    return lines.join(points, "n").select("fiber_id", "seq", "x", "y", "z"), fibers
