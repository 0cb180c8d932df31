"""Exact top-k by inner product with two cover trees that are descended together.

A cover-tree node has a centre row and a covering radius, the largest distance of any of its rows from the centre; its
children's centres are chosen farthest first until they cover at half the radius or there are BRANCH of them. For query
node Q and data node P no product exceeds <q, p> + r_Q |p| + r_P |q| + r_Q r_P, with the centres' product and norms. A
node pair is pruned when that is below the worst kth score of Q's queries so far; scores equal to it are still looked at,
as ties go to the smaller id.

At scale rows are dealt to the nearest of a bounded number of pivots, and pivots with many rows to several chunks of about
CHUNK rows, so that a hot region is many tasks. Each chunk becomes a block with a tree's root bound. Every chunk first
searches itself, which gives each of its query groups a worst kth score. Query groups then meet the other blocks in equal
shares; a pair whose bound falls short goes no further, before any vectors are moved. What is left is solved pair by pair.

Components are integers, floor(SCALE x); products are exact (in floating point below 2^53, in 64-bit integers beyond).
Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without a key. Repeated rows
count once; of rows that share an id and differ, the best score counts. A query has fewer than k results if there are fewer other rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filamenta.llm.vectors import pivots, taking_part
from filamenta.session import staged

SCALE = 256
CHUNK = 4096
QUERIES = 512
LEAF, BRANCH = 64, 16
BATCH = 64


class Tree:
    """A cover tree over the rows of a matrix of integers held as doubles."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []  # (centre, its norm, radius, start, stop, children)
        if len(x):
            self._build(0, len(x))

    def _build(self, start: int, stop: int) -> int:
        rows = self.order[start:stop]
        points = self.x[rows]
        middle = points.mean(0)
        centre = points[np.argmin(((points - middle) ** 2).sum(1))]
        far = np.sqrt(((points - centre) ** 2).sum(1))
        radius = float(far.max())
        number = len(self.nodes)
        self.nodes.append(())
        children: list[int] = []
        if stop - start > LEAF and radius > 0:
            near, owner = far, np.zeros(len(rows), np.int64)
            for k in range(1, BRANCH):  # farthest first: centres stay apart by more than what is covered
                pick = int(np.argmax(near))
                if near[pick] <= radius / 2:
                    break
                d = np.sqrt(((points - points[pick]) ** 2).sum(1))
                closer = d < near
                owner[closer], near = k, np.minimum(d, near)
            sizes = np.bincount(owner)
            if (sizes > 0).sum() > 1:
                self.order[start:stop] = rows[np.argsort(owner, kind="stable")]
                at = start
                for n in sizes[sizes > 0]:
                    children.append(self._build(at, at + int(n)))
                    at += int(n)
        self.nodes[number] = (centre, float(np.sqrt((centre**2).sum())), radius, start, stop, children)
        return number


def upper(qc: np.ndarray, qn: float, qr: float, pc: np.ndarray, pn: float, pr: float) -> float:
    """The largest product that any query and row of two nodes can have, with room for rounding."""
    bound = float(qc @ pc) + qr * pn + pr * qn + qr * pr
    return bound + 1e-9 * (abs(bound) + qn * pn) + 1e-6


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return a @ b.T if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def search(queries: Tree, qid: np.ndarray, data: Tree, pid: np.ndarray, k: int, worst: np.ndarray) -> list[list[tuple]]:
    """Per query a heap of its k best (score, -id) in ``data``; ``worst`` has scores that are known to be reached k times."""
    best: list[list[tuple]] = [[] for _ in qid]
    if not len(qid) or not len(pid):
        return best
    floor = worst.astype(float).copy()

    def bound(i: int, j: int) -> float:
        q, p = queries.nodes[i], data.nodes[j]
        return upper(q[0], q[1], q[2], p[0], p[1], p[2])

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, i, j = heapq.heappop(heap)
        q, p = queries.nodes[i], data.nodes[j]
        rows = queries.order[q[3] : q[4]]
        if -top < floor[rows].min():
            continue
        if q[5] and (not p[5] or q[2] >= p[2]):
            pairs = [(c, j) for c in q[5]]
        elif p[5]:
            pairs = [(i, c) for c in p[5]]
        else:
            others = data.order[p[3] : p[4]]
            scores = _products(queries.x[rows], data.x[others])
            good = (scores >= floor[rows][:, None]) & (qid[rows][:, None] != pid[others][None])
            for a, b in zip(*np.nonzero(good), strict=True):
                r, item = rows[a], (int(scores[a, b]), -int(pid[others[b]]))
                if len(best[r]) < k:
                    heapq.heappush(best[r], item)
                elif item > best[r][0]:
                    heapq.heapreplace(best[r], item)
            for r in rows:
                if len(best[r]) == k:
                    floor[r] = max(floor[r], best[r][0][0])
            continue
        for a, b in pairs:
            heapq.heappush(heap, (-bound(a, b), a, b))
    return best


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


BLOCK = "chunk int, part int, queries boolean, ids array<long>, z binary, dim int, center array<double>, norm double, radius double, worst array<double>, found array<struct<query_id:long,vec_id:long,score:long>>"
FOUND = "query_id long, vec_id long, score long"


def _frame(found: list[list[tuple]], qid: np.ndarray) -> pd.DataFrame:
    rows = [(int(q), -i, s) for q, best in zip(qid, found, strict=True) for s, i in best]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")


def _block(k: int):
    """A chunk's rows become one data block and its query groups, each with what its own chunk already reaches."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[sorted({(i, np.asarray(v).tobytes()): n for n, (i, v) in enumerate(zip(group["id"], group["z"], strict=True))}.values())]
        z, ids, asked = _matrix(group["z"]), group["id"].to_numpy(), group["asked"].to_numpy(bool)
        data = Tree(z)
        out = []

        def add(part: int, queries: bool, rows: np.ndarray, tree: Tree, worst, found: list) -> None:
            c, n, r = tree.nodes[0][:3]
            out.append((int(group["chunk"].iloc[0]), part, queries, ids[rows], z[rows].astype("<f8").tobytes(), z.shape[1], c, n, r, worst, found))

        add(0, False, np.arange(len(z)), data, np.zeros(0), [])
        mine = np.flatnonzero(asked)
        for part, at in enumerate(range(0, len(mine), QUERIES)):
            rows = mine[at : at + QUERIES]
            tree = Tree(z[rows])
            best = search(tree, ids[rows], data, ids, k, np.full(len(rows), -np.inf))
            found = _frame(best, ids[rows]).to_dict("records")
            add(part, True, rows, tree, np.array([b[0][0] if len(b) == k else -np.inf for b in best], np.float64), found)
        names = [f.split()[0] for f in BLOCK.split(", ")]
        return pd.DataFrame(out, columns=names)

    return run


def _solve(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One data block against some of the query groups that may have results there."""
        if not len(left) or not len(right):
            return _frame([], np.zeros(0, np.int64))
        block = left.iloc[0]
        read = lambda r: np.frombuffer(r["z"], "<f8").reshape(-1, r["dim"])
        data, pid = Tree(read(block)), np.asarray(block["ids"])
        parts = []
        for _, r in right.iterrows():
            qid = np.asarray(r["ids"])
            parts.append(_frame(search(Tree(read(r)), qid, data, pid, k, np.asarray(r["worst"])), qid))
        return pd.concat(parts)

    return run


def _nearest_pivot(points: list[list[float]]):
    centres = np.array(points)
    square = (centres**2).sum(1) / 2 if len(points) else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.argmax(_matrix(f["z"]) @ centres.T - square, axis=1) if len(f) else []
            yield f.assign(cell=np.asarray(cell, np.int32))

    return run


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, z) from (id, v): floor(scale * x), as doubles."""
    return rows.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("z"))


def top_k(rows: DataFrame, asked: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each asked row's k best other rows. ``asked`` is a condition on column ``id``."""
    z = integers(taking_part(rows, key, vector), scale).withColumn("asked", asked)
    centres = pivots(z.select("id", F.col("z").alias("v")))
    celled = staged(z.mapInPandas(_nearest_pivot(centres), "id long, z array<double>, asked boolean, cell int"), "cells")
    splits = {r["cell"]: -(-r["count"] // CHUNK) for r in celled.groupBy("cell").count().collect()}
    first, total = {}, 0
    for cell, n in sorted(splits.items()):
        first[cell], total = total, total + n
    if not total:
        return celled.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    at = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    many = F.create_map(*[F.lit(x) for kv in splits.items() for x in kv])
    chunked = celled.withColumn("chunk", (at[F.col("cell")] + F.pmod(F.xxhash64("id"), many[F.col("cell")])).cast("int"))
    blocks = staged(chunked.groupBy("chunk").applyInPandas(_block(k), BLOCK), "blocks")
    data, groups = blocks.where(~F.col("queries")), blocks.where("queries")
    # Bounds first, on centres alone: query groups in equal shares of blocks
    shares = -(-total // BATCH)
    light = data.select(F.col("chunk").alias("block"), F.pmod("chunk", F.lit(shares)).alias("share"), F.col("center").alias("pc"), F.col("norm").alias("pn"), F.col("radius").alias("pr"))
    asking = groups.select("chunk", "part", "center", "norm", "radius", F.array_min("worst").alias("least"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    dot = F.aggregate(F.zip_with("center", "pc", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("radius") * F.col("pn") + F.col("pr") * F.col("norm") + F.col("radius") * F.col("pr")
    room = 1e-9 * (F.abs(bound) + F.col("norm") * F.col("pn")) + 1e-6
    pairs = asking.join(light, "share").where((bound + room >= F.col("least")) & (F.col("block") != F.col("chunk"))).select("chunk", "part", "block")
    right = pairs.join(groups.select("chunk", "part", "ids", "z", "dim", "worst"), ["chunk", "part"]).withColumn("batch", F.pmod(F.xxhash64("chunk", "part"), F.lit(-(-total // BATCH))))
    left = data.select(F.col("chunk").alias("block"), "ids", "z", "dim").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(shares - 1).cast("int"))))
    right = right.withColumn("batch", F.col("batch").cast("int"))
    elsewhere = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInPandas(_solve(k), FOUND)
    own = groups.select(F.explode("found").alias("f")).select("f.*")
    return ranked(own.unionByName(elsewhere), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k highest scores, ties to the smaller id; a pair that was found twice counts once, at its best."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
