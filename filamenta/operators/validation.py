"""Checks that report every issue with a stable code, and dense ids for names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.operators import segments as sg
from filamenta.operators.numbering import numbered


def issues(v: DataFrame, fibers: DataFrame, materials: DataFrame, least_vertices: int = 2, least_radius: float = 0.0) -> DataFrame:
    """(code, id, at): zero-length segments, points that are not finite, short fibers, unknown materials, section sizes."""
    w = sg.along()
    same = reduce(lambda a, b: a & b, [F.lag(c).over(w) == F.col(c) for c in "xyz"])
    zero = v.withColumn("same", same).where("same").select(F.lit("zero_length_segment").alias("code"), F.col("fiber_id").alias("id"), (F.col("seq") - 1).cast("long").alias("at"))
    bad = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull() for c in "xyz"])
    points = v.where(bad).select(F.lit("non_finite_point").alias("code"), F.col("fiber_id").alias("id"), F.col("seq").cast("long").alias("at"))
    few = v.groupBy("fiber_id").agg(F.count("*").alias("n")).where(F.col("n") < least_vertices).select(F.lit("too_few_vertices").alias("code"), F.col("fiber_id").alias("id"), F.col("n").alias("at"))
    unknown = fibers.join(materials, "material_id", "left_anti").select(F.lit("unknown_material").alias("code"), F.col("fiber_id").alias("id"), F.col("material_id").cast("long").alias("at"))
    size = fibers.where(~(F.col("radius") > least_radius)).select(F.lit("section_size").alias("code"), F.col("fiber_id").alias("id"), F.col("section_id").cast("long").alias("at"))
    return reduce(DataFrame.unionByName, [zero, points, few, unknown, size])


def interned(df: DataFrame, name: str, order: str) -> DataFrame:
    """(name, id): names by first occurrence, numbered from 0."""
    first = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("first"))
    return numbered(first, ["first", "name"], "id").select("name", "id")
