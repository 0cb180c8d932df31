"""Contacts that fibers placed at random would have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.functions import random as rnd
from filamenta.operators import segments as sg
from filamenta.operators.numbering import numbered
from filamenta.session import staged


def random_baseline(vertices: DataFrame, radii: DataFrame, spacing: float, contact_gap: float, volume: float, pairs: int = 20_000, seed: int = 0) -> DataFrame:
    """One row (pairs, contacts): contacts per unit of length of the same fibers at random places, from drawn sample pairs.

    Samples are even in arc length, so a sample drawn evenly is weighted by length. They are numbered without a gap and the
    2 * ``pairs`` drawn numbers joined with them; pairs of one fiber are left out. No row where fewer than two fibers or
    samples, no volume or no pairs are given, or where every pair was of one fiber.
    """
    spark = vertices.sparkSession
    s = sg.resampled(vertices, spacing, tangent=True).join(radii.select("fiber_id", "radius"), "fiber_id")
    samples = staged(numbered(s.select("fiber_id", "k", "tx", "ty", "tz", "radius"), ["fiber_id", "k"]), "baseline-samples")
    count = samples.agg(F.count("*").alias("samples"), F.min("fiber_id").alias("low"), F.max("fiber_id").alias("high")).where("samples > 1 and low < high")
    length = sg.segments(vertices).agg(F.sum("len").alias("length"))
    draws = spark.range(pairs).join(F.broadcast(count))  # one row
    asked = draws.select("id", *[rnd.index(2 * F.col("id") + k, seed, F.col("samples")).alias(f"n{k}") for k in (0, 1)])
    side = lambda k: samples.select(F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("fiber_id", "tx", "ty", "tz", "radius")])
    both = asked.join(side(0), "n0").join(side(1), "n1").where("fiber_id_0 <> fiber_id_1")
    cosine = F.least(F.abs(g.dot(g.vec("t", "_0"), g.vec("t", "_1"))), F.lit(1.0))
    reach = F.col("radius_0") + F.col("radius_1") + contact_gap
    sums = both.agg(F.count("*").alias("pairs"), F.sum(reach * F.sqrt(1 - cosine * cosine)).alias("sum")).where("pairs > 0")
    out = sums.join(length).select("pairs", (2 * F.col("length") / F.lit(float(volume or 1.0)) * F.col("sum") / F.col("pairs")).alias("contacts"))  # one row each
    return out if volume > 0 else out.limit(0)
