"""Generators of fiber tables. A fiber's numbers depend on its own id (and seed), so fibers are made in parallel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def point_crossing(spark: SparkSession, count: int, length: float, centre: tuple[float, float, float]) -> DataFrame:
    """(fiber_id, seq, x, y, z): ``count`` straight fibers through ``centre`` with even directions."""
    i = F.col("id") + 0.5
    z = 1 - 2 * i / count
    a = F.lit(math.pi * (1 + math.sqrt(5))) * i
    r = F.sqrt(1 - z * z)
    d = spark.range(count).select(F.col("id").alias("fiber_id"), (r * F.cos(a)).alias("dx"), (r * F.sin(a)).alias("dy"), z.alias("dz"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return d.select("fiber_id", "seq", *[(F.lit(centre[k]) + (2 * F.col("seq") - 1) * (length / 2) * F.col(f"d{c}")).alias(c) for k, c in enumerate("xyz")])


def wavy(spark: SparkSession, count: int, segments: int, length: float, amplitude: float, helicity: float) -> DataFrame:
    rows = spark.range(count).select(F.col("id").alias("fiber_id"), F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("seq"))
    c = F.col("seq") / float(segments)
    return rows.select("fiber_id", "seq", (c * length).alias("x"), (amplitude * F.sin(2 * math.pi * c)).alias("y"), (amplitude / 2 * helicity * F.sin(4 * math.pi * c)).alias("z"))


def pair_crossing(spark: SparkSession, length: float, angle: float, offset: float) -> DataFrame:
    rows = spark.range(2).select(F.col("id").alias("fiber_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    side, a = (2 * F.col("seq") - 1) * (length / 2), F.col("fiber_id") * angle
    return rows.select("fiber_id", "seq", (side * F.cos(a)).alias("x"), (side * F.sin(a)).alias("y"), (F.col("fiber_id") * offset).alias("z"))


def population(spark: SparkSession, count: int, length: float, cell: float, seed: int = 7, spread: float = math.pi) -> DataFrame:
    """Straight fibers with a seed of their own: centres uniform in the cell less half a length, axes within ``spread`` of x.

    Draws are hashes of (seed, fiber id, number), so any partitioning gives the same fibers.
    """

    def draw(n: int):
        return F.crc32(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(n)).cast("binary")) / F.lit(2.0**32)

    cos = 1 - draw(0) * (1 - math.cos(spread))
    around = 2 * math.pi * draw(1)
    sin = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos))
    d = [cos, sin * F.cos(around), sin * F.sin(around)]
    room = cell - length
    rows = spark.range(count).select(F.col("id").alias("fiber_id"), *[(length / 2 + room * draw(2 + k)).alias(f"c{c}") for k, c in enumerate("xyz")], *[x.alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)])
    rows = rows.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("fiber_id", "seq", *[(F.col(f"c{c}") + (2 * F.col("seq") - 1) * (length / 2) * F.col(f"d{c}")).alias(c) for c in "xyz"])
