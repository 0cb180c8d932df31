"""Fits of centrelines as JSON, and analysis reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "schema string, voxel_size double, shape array<long>, fibers array<struct<radius:double,type:int,centerline:array<array<double>>>>"


def load_fit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fibers, vertices) of fit files; fiber_id counts fibers within a file."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    f = raw.select(F.input_file_name().alias("file"), F.posexplode("fibers").alias("fiber_id", "f"))
    fibers = f.select("file", "fiber_id", F.col("f.radius").alias("radius"), F.col("f.type").alias("type"))
    v = f.select("file", "fiber_id", F.posexplode("f.centerline").alias("seq", "p"))
    return fibers, v.select("file", "fiber_id", "seq", *[F.col("p")[k].alias(c) for k, c in enumerate("xyz")])


def write_report(df: DataFrame, path: str) -> None:
    """A small result (one row per material or fiber type) as pretty JSON lines in Spark's folder layout."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.text(path)


def report_text(df: DataFrame, limit: int = 1000) -> str:
    """The same for a driver: refuses results of over ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    return json.dumps({"schema": 1, "rows": [r.asDict(recursive=True) for r in rows]}, indent=2, sort_keys=True)


def write_frames(vertices: DataFrame, iteration: int, path: str) -> None:
    """Appends a trajectory frame, partitioned by iteration."""
    vertices.withColumn("iteration", F.lit(iteration)).write.mode("append").partitionBy("iteration").parquet(path)
