"""Vectors as rows of numbers: which take part, and groups of rows that are close to one of a bounded set of pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many pivots, those with the smallest hash: the only rows that go to the driver.
PIVOTS = 64


def finite(vector: Column) -> Column:
    """True for vectors that are not null, not empty and hold only finite numbers."""
    x = lambda v: v.cast("double")
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def taking_part(rows: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v): rows with a key and a finite vector; without ``zero`` also no all-zero ones.

    Vectors have the commonest length (the longer of equally common ones); others take no part, as no score is defined.
    """
    v = F.col(vector)
    kept = rows.where(F.col(key).isNotNull() & finite(v))
    if not zero:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    common = kept.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = kept.where(F.size(v) == (common["n"] if common else 0))
    return kept.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def pivots(rows: DataFrame, most: int = PIVOTS) -> list[list[float]]:
    """Up to ``most`` vectors of ``rows`` (id, v), by the hash of their id."""
    return [list(r["v"]) for r in rows.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(most).select("v").collect()]
