"""Joins on grid cells, and joins with a table of one row a key, where some keys hold a large share of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with over 1 / SHARE of all rows, and FEW at least, are hot: there are fewer than SHARE of them.
SHARE, FEW = 256, 64


def cell_join(a: DataFrame, b: DataFrame, cells: list[str]) -> DataFrame:
    """``a`` and ``b`` joined on grid cells, by shuffles on both sides.

    Spark's estimate knows nothing of the rows that listing a row in many cells makes, so it would take a small table that is
    listed for one to broadcast, and the driver would hold every listed row.
    """
    return a.join(b.hint("merge"), cells)


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str] | str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, whose column ``count`` says how many of the ``total`` rows have its key.

    Rows of hot keys stay where they are: fewer than SHARE rows of ``keyed`` are broadcast to them. The other keys are
    joined by a shuffle, in which no key brings more than 1 / SHARE of the rows. ``how`` is inner or left.
    """
    on = [on] if isinstance(on, str) else on
    most = max(FEW, total // SHARE)
    hot = keyed.where(F.col(count) > most)
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) <= most), on, how)
    return near.unionByName(far)
