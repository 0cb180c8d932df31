"""Graphs: connected components by local contraction and alternating large-star and small-star steps.

HELD edges or fewer are solved by one task. Of more, each task first replaces its own by stars of the components that they
form, so that most edges never move; what is left goes through rounds until it is as few or settled. A round is two aggregations by node and two joins; a hub, whose key would bring a large share of the edges to one task, is
joined by broadcast, and there are few of them. Nothing but two numbers a round reaches the driver, and each round's edges
go to the shared folder, so that a lost executor costs one round at most. Loops, repeated edges and null ends are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.operators.joins import hot_join
from filamenta.session import staged

#: Edges that a task holds before it contracts them, and that one task may finish.
HELD = 1 << 20


def forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that each of n nodes reaches over the links (i, j) and those that made ``root``."""
    root = np.arange(n) if root is None else root
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, code = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = forest(len(names), code[: len(u)], code[len(u) :])
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each of a task's nodes with the smallest node that it reaches over the task's edges."""
    held, size, kind = [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += batch.num_rows
        if size > HELD:
            held = [_stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0]) // 2  # so that a large star is not contracted again with every batch
    if held:
        u, v = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(edges with m, the smallest v of their u; (u, m, n), one row a node)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return hot_join(edges, least, "u", "n", total), least


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour (u itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows, _ = _with_least(both, 2 * total)
    return rows.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows, least = _with_least(down, total)
    return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is its smallest reachable node.

    An edge table without usable rows gives an empty result.
    """
    kind = edges.schema[a].dataType
    rows = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).where("u <> v")
    schema = f"u {kind.simpleString()}, v {kind.simpleString()}"
    now, mark = staged(rows, "edges"), None  # first, as rows may come from Python: a task has one worker at a time
    if now.count() > HELD:
        now = staged(now.mapInArrow(_contracted, schema), "edges")
    while (n := now.count()) > HELD:
        found = now.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        if (n, found) == mark:
            break
        mark = (n, found)
        near = _large_star(now, n).mapInArrow(_contracted, schema)
        now = staged(_small_star(near, n).distinct(), "edges")
    else:
        now = staged(now.coalesce(1).mapInArrow(_contracted, schema), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
