"""Volumes in blocks of voxels: filters, the Hessian and the axes of tubes.

A volume is a table of blocks (bz, by, bx, data), each the voxels of a box of at most ``size`` an axis as packed doubles in
(z, y, x) order. A filter of reach h needs h voxels of the blocks around: every block sends its neighbours the slabs that
they lack (far less than the block), and each block is then filtered for itself, axis by axis. Beyond the volume's faces
voxels are mirrored (d c b a | a b c d). Nothing depends on the volume's size but the number of blocks.

Voxels that a table of rows lacks are 0. A volume has a shape (z, y, x); voxels outside it are an error of the caller's and
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.session import staged


Shape = tuple[int, int, int]
SIZE = 32
#: Voxels of a hole that blocks find with what is around them.
NEAR = 16
#: Bytes of voxels for a task, and the most tasks that blocks are dealt to.
TASK_BYTES, MOST_TASKS = 1 << 22, 1 << 12
_BLOCK = "bz int, by int, bx int, data binary"
_KEYS = ["bz", "by", "bx"]
#: Hessian components by name, with the derivative's order along z, y and x.
COMPONENTS = {"xx": (0, 0, 2), "yy": (0, 2, 0), "zz": (2, 0, 0), "xy": (0, 1, 1), "xz": (1, 0, 1), "yz": (1, 1, 0)}


def _tasks(shape: Shape, size: int) -> int:
    """Tasks to deal a volume's blocks to: by the voxels, as blocks that are all alike are small only while they are moved."""
    blocks = math.prod(-(-n // size) for n in shape)
    return max(1, min(MOST_TASKS, -(-8 * blocks * math.prod(min(size, n) for n in shape) // TASK_BYTES)))


def _box(shape: Shape, size: int, block: tuple[int, int, int]) -> list[tuple[int, int]]:
    return [(b * size, min((b + 1) * size, n)) for b, n in zip(block, shape, strict=True)]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list[np.ndarray]]]]:
    """Runs of rows of equal keys, as lists of column pieces; rows come sorted by the keys."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            key = tuple(int(c[lo]) for c in columns[:keys])
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append([c[lo:hi] for c in columns[keys:]])
    if held:
        yield now, held


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*_KEYS, "data"])


def to_blocks(rows: DataFrame, shape: Shape, size: int = SIZE) -> DataFrame:
    """(bz, by, bx, data) of voxels (z, y, x, v); of a voxel that is there twice, either."""
    block = [F.floor(F.col(c) / size).cast("int").alias(f"b{c}") for c in "zyx"]
    inside = " and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("zyx", shape, strict=True))
    ready = rows.where(inside).select(*block, *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("v").cast("double").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's voxels of one block in one row, places in the block and values as bytes."""
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, z, y, x, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            place = (((z % size) * size + y % size) * size + x % size)[order].astype(np.int32)
            edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(order)]
            v = v[order]
            cut = [[d[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)] for d in (place, v)]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[edges[:-1]]) for k in keys], *[pa.array(c, pa.binary()) for c in cut]], [*_KEYS, "place", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _runs(batches, 3):
            data = np.zeros((size,) * 3)
            for places, values in parts:
                for place, v in zip(places, values, strict=True):
                    data.reshape(-1)[np.frombuffer(place, np.int32)] = np.frombuffer(v)
            lengths = [hi - lo for lo, hi in _box(shape, size, key)]
            yield _batch([(*key, np.ascontiguousarray(data[tuple(slice(0, n) for n in lengths)]).tobytes())])

    sent = ready.mapInArrow(packed, "bz int, by int, bx int, place binary, v binary")
    return sent.repartition(_tasks(shape, size), *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, _BLOCK)


def to_rows(blocks: DataFrame, shape: Shape, names: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(z, y, x, v): the voxels of blocks; with ``names`` a column each for values that follow one another in the data."""
    names = names or ["v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bz, by, bx, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                box = _box(shape, size, (bz, by, bx))
                at = np.indices([hi - lo for lo, hi in box]).reshape(3, -1)
                values = np.frombuffer(data).reshape(len(names), -1)
                places = [pa.array(a + lo) for a, (lo, _) in zip(at, box, strict=True)]
                yield pa.RecordBatch.from_arrays([*places, *[pa.array(v) for v in values]], ["z", "y", "x", *names])

    return blocks.select(*_KEYS, "data").mapInArrow(run, ", ".join(["z long, y long, x long", *[f"{n} double" for n in names]]))


def mapped(blocks: DataFrame, solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Blocks of ``solve`` of each block's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([solve(np.frombuffer(d)).tobytes() for d in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], data], [*_KEYS, "data"])

    return blocks.select(*_KEYS, "data").mapInArrow(run, _BLOCK)


def _slabs(shape: Shape, size: int, halo: int):
    """What each block sends: its own voxels to itself, and to others those within ``halo`` of them."""

    def spread(b: int, n: int) -> list[tuple[int, int, int]]:
        """(block, first, last) along an axis: who needs which of this block's voxels."""
        lo, hi = b * size, min((b + 1) * size, n)
        out = []
        for t in range(max(0, (lo - halo) // size), min(-(-n // size) - 1, (hi - 1 + halo) // size) + 1):
            first, last = max(lo, t * size - halo), min(hi, min((t + 1) * size, n) + halo)
            if first < last:
                out.append((t, first, last))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bz, by, bx, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                box = _box(shape, size, (bz, by, bx))
                whole = np.frombuffer(data).reshape([hi - lo for lo, hi in box])
                rows = []
                for tz, z0, z1 in spread(bz, shape[0]):
                    for ty, y0, y1 in spread(by, shape[1]):
                        for tx, x0, x1 in spread(bx, shape[2]):
                            cut = whole[z0 - box[0][0] : z1 - box[0][0], y0 - box[1][0] : y1 - box[1][0], x0 - box[2][0] : x1 - box[2][0]]
                            rows.append((tz, ty, tx, z0, z1, y0, y1, x0, x1, cut.tobytes()))
                types = [pa.int32()] * 3 + [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*_KEYS, "z0", "z1", "y0", "y1", "x0", "x1", "data"])

    return run


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places on an axis of n voxels, mirrored at its ends."""
    k = np.mod(at, 2 * n)
    return np.where(k < n, k, 2 * n - 1 - k)


def filtered(blocks: DataFrame, shape: Shape, halo: int, solve: Callable[[np.ndarray], np.ndarray], size: int = SIZE, mirror: bool = True, beyond: float = 0.0) -> DataFrame:
    """Blocks of ``solve`` of each block with ``halo`` voxels around it: values of the block, one array or several.

    Beyond the volume's faces voxels are mirrored, or ``beyond``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _runs(batches, 3):
            box = _box(shape, size, key)
            low = [max(0, lo - halo) for lo, _ in box]
            held = np.zeros([min(n, hi + halo) - a for a, (_, hi), n in zip(low, box, shape, strict=True)])
            for columns in parts:
                for z0, z1, y0, y1, x0, x1, data in zip(*columns, strict=True):
                    held[z0 - low[0] : z1 - low[0], y0 - low[1] : y1 - low[1], x0 - low[2] : x1 - low[2]] = np.frombuffer(data).reshape(z1 - z0, y1 - y0, x1 - x0)
            for axis, ((lo, hi), n) in enumerate(zip(box, shape, strict=True)):
                if mirror:
                    held = np.take(held, mirrored(np.arange(lo - halo, hi + halo), n) - low[axis], axis=axis)
                else:
                    gaps = [(0, 0)] * 3
                    gaps[axis] = (max(0, halo - lo), max(0, hi + halo - n))
                    held = np.pad(held, gaps, constant_values=beyond)
            yield _batch([(*key, np.ascontiguousarray(solve(held), float).tobytes())])

    sent = blocks.select(*_KEYS, "data").mapInArrow(_slabs(shape, size, halo), "bz int, by int, bx int, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long, data binary")
    return sent.repartition(_tasks(shape, size), *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, _BLOCK)


def kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    """Weights of a Gaussian or its first or second derivative, to be correlated along an axis."""
    reach = int(truncate * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    if order == 1:
        return w * x / sigma**2
    return w * (x**2 / sigma**4 - 1 / sigma**2) if order == 2 else w


def along(held: np.ndarray, axis: int, weights: np.ndarray) -> np.ndarray:
    """Correlation along an axis; the result is shorter by the weights' reach on both sides."""
    n = held.shape[axis] - len(weights) + 1
    return sum(w * np.take(held, np.arange(k, k + n), axis=axis) for k, w in enumerate(weights))


def gaussian(blocks: DataFrame, shape: Shape, sigma: float, order: Shape = (0, 0, 0), size: int = SIZE) -> DataFrame:
    """Blocks smoothed at ``sigma``, or derivatives of the smoothed volume of ``order`` along z, y and x."""
    kernels = [kernel(sigma, o) for o in order]

    def solve(held: np.ndarray) -> np.ndarray:
        for axis, w in enumerate(kernels):
            held = along(held, axis, w)
        return held

    return filtered(blocks, shape, len(kernels[0]) // 2, solve, size)


def _second(held: np.ndarray, kernels: list[np.ndarray], scale: float) -> dict[str, np.ndarray]:
    """The Hessian's components; passes along z, and then y, are shared."""
    z = {o: along(held, 0, kernels[o]) for o in range(3)}
    zy = {k: along(z[k[0]], 1, kernels[k[1]]) for k in dict.fromkeys(c[:2] for c in COMPONENTS.values())}
    return {name: scale * along(zy[c[:2]], 2, kernels[c[2]]) for name, c in COMPONENTS.items()}


def hessian(blocks: DataFrame, shape: Shape, sigma: float, size: int = SIZE) -> DataFrame:
    """Blocks of the six second derivatives at scale ``sigma``, times its square, one after the other as in COMPONENTS."""
    kernels = [kernel(sigma, o) for o in range(3)]
    return filtered(blocks, shape, len(kernels[0]) // 2, lambda held: np.stack(list(_second(held, kernels, sigma**2).values())), size)


def matrices(h: dict[str, np.ndarray]) -> np.ndarray:
    """Symmetric 3 x 3 matrices in the order x, y, z."""
    return np.stack([np.stack([h[min(a, b) + max(a, b)] for b in "xyz"], -1) for a in "xyz"], -2)


def tube_strength(blocks: DataFrame, shape: Shape, sigma: float, size: int = SIZE) -> DataFrame:
    """Blocks: how strongly the volume curves down across a tube; the weaker of the two largest curvatures, 0 where not both are down."""
    kernels = [kernel(sigma, o) for o in range(3)]

    def solve(held: np.ndarray) -> np.ndarray:
        values = np.linalg.eigvalsh(matrices(_second(held, kernels, sigma**2)))
        values = np.take_along_axis(values, np.argsort(np.abs(values), axis=-1), axis=-1)
        weaker = np.maximum(values[..., 1], values[..., 2])
        return np.where(weaker < 0, -weaker, 0.0)

    return filtered(blocks, shape, len(kernels[0]) // 2, solve, size)


def directions(blocks: DataFrame, shape: Shape, sigma: float, points: DataFrame, size: int = SIZE) -> DataFrame:
    """points (id, px, py, pz) with the tube's axis (ax, ay, az) and its tubularity there.

    The Hessian is read between voxel centres. The axis is the eigenvector of the smallest curvature, its largest component
    positive; tubularity is minus the mean of the other two. Beyond the outermost centres the Hessian is 0, the axis x.
    """
    rows = to_rows(hessian(blocks, shape, sigma, size), shape, list(COMPONENTS), size)
    corners = F.array(*[F.struct(*[F.lit(i >> k & 1).alias(c) for k, c in enumerate("xyz")]) for i in range(8)])
    at = {c: F.col(f"p{c}") - 0.5 for c in "xyz"}
    each = points.withColumn("_c", F.explode(corners))
    weight = F.lit(1.0)
    for c in "xyz":
        part = at[c] - F.floor(at[c])
        weight = weight * F.when(F.col(f"_c.{c}") == 1, part).otherwise(1 - part)
    each = each.select("id", "px", "py", "pz", weight.alias("_w"), *[(F.floor(at[c]) + F.col(f"_c.{c}")).cast("long").alias(c) for c in "zyx"]).where("_w > 0 and not isnan(_w)")
    met = each.join(rows, ["z", "y", "x"], "left").groupBy("id").agg(F.count_if(F.col("xx").isNull()).alias("out"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in COMPONENTS])
    full = points.join(met, "id", "left").select("id", "px", "py", "pz", *[F.when(F.col("out") == 0, F.col(c)).otherwise(0.0).alias(c) for c in COMPONENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = {c: batch.column(4 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(COMPONENTS)}
            values, vectors = np.linalg.eigh(matrices(h))
            order = np.argsort(np.abs(values), axis=1, kind="stable")
            values = np.take_along_axis(values, order, axis=1)
            axis = np.take_along_axis(vectors, order[:, None, :], axis=2)[:, :, 0]
            top = np.take_along_axis(axis, np.argmax(np.round(np.abs(axis), 9), axis=1)[:, None], axis=1)
            axis = np.where(np.abs(values).max(1, keepdims=True) > 0, axis * np.sign(top), [1.0, 0.0, 0.0])
            out = [*[batch.column(k) for k in range(4)], *[pa.array(axis[:, k]) for k in range(3)], pa.array(-0.5 * (values[:, 1] + values[:, 2]))]
            yield pa.RecordBatch.from_arrays(out, ["id", "px", "py", "pz", "ax", "ay", "az", "tubularity"])

    return full.mapInArrow(run, f"id {points.schema['id'].dataType.simpleString()}, px double, py double, pz double, ax double, ay double, az double, tubularity double")


def distance_transform(blocks: DataFrame, shape: Shape, size: int = SIZE) -> DataFrame:
    """Blocks of each voxel's exact distance to the nearest voxel that is not 0; infinite where there is none.

    A block sees the voxels up to a reach around it, which settles all distances up to the reach; while some are not settled
    the reach doubles. So a volume costs what its deepest void needs, and nothing is passed along whole axes.
    """

    def within(reach: int) -> DataFrame:
        def solve(held: np.ndarray) -> np.ndarray:
            far = np.where(held != 0, 0.0, np.inf)
            for axis in range(3):
                n = far.shape[axis] - 2 * reach
                least = np.full([*far.shape[:axis], n, *far.shape[axis + 1 :]], np.inf)
                for k in range(2 * reach + 1):
                    np.minimum(least, np.take(far, np.arange(k, k + n), axis=axis) + (k - reach) ** 2, out=least)
                far = least
            return np.sqrt(np.where(far <= reach * reach, far, np.inf))

        return staged(filtered(blocks, shape, reach, solve, size, mirror=False), "blocks-distance")

    def left(found: DataFrame) -> bool:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_ = sum(int(np.isinf(np.frombuffer(data)).any()) for batch in batches for data in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64())], ["n"])

        return bool(found.select("data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0])

    def bright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = any(np.frombuffer(data).any() for batch in batches for data in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([some])], ["some"])

    reach = size // 2
    found = within(reach)
    if blocks.select("data").mapInArrow(bright, "some boolean").agg(F.max("some")).first()[0]:
        while reach * reach < sum(n * n for n in shape) and left(found):
            reach *= 2
            found = within(reach)
    return found


def core_holes(mask: DataFrame, shape: Shape, most: int) -> DataFrame:
    """(z, y, x): voxels outside ``mask`` (z, y, x) that a slice along some axis encloses, in regions of at most ``most``.

    Each axis has its own slices; a region of a slice counts by its four neighbours there and is open if it meets the edge.
    A region of at most NEAR voxels lies that near to each of its own, so a block finds it with as many voxels around it;
    larger ones are found over the whole volume.
    """
    if most <= NEAR:
        return _holes_in_blocks(mask, shape, most)
    from filamenta.operators.graph import connected_components

    spark = mask.sparkSession
    grid = spark.range(shape[0] * shape[1] * shape[2]).select(F.col("id"), F.expr(f"id div {shape[1] * shape[2]}").alias("z"), F.expr(f"id div {shape[2]} % {shape[1]}").alias("y"), F.expr(f"id % {shape[2]}").alias("x"))
    void = grid.join(mask.select("z", "y", "x").distinct(), ["z", "y", "x"], "left_anti")
    step = {"z": shape[1] * shape[2], "y": shape[2], "x": 1}
    size = dict(zip("zyx", shape, strict=True))
    found = None
    for axis in "zyx":
        plane = [c for c in "zyx" if c != axis]
        edges = None
        for c in plane:
            near = void.where(F.col(c) < size[c] - 1).select(F.col("id").alias("a"), (F.col("id") + step[c]).alias("b")).join(void.select(F.col("id").alias("b")), "b", "left_semi")
            edges = near if edges is None else edges.unionByName(near)
        named = void.join(connected_components(edges, "a", "b"), F.col("id") == F.col("node"), "left").withColumn("region", F.coalesce("component", "id"))
        rim = F.lit(False)
        for c in plane:
            rim |= (F.col(c) == 0) | (F.col(c) == size[c] - 1)
        closed = named.groupBy("region").agg(F.count("*").alias("n"), F.max(rim).alias("open")).where((F.col("n") <= most) & ~F.col("open"))
        part = named.join(closed.select("region"), "region", "left_semi").select("z", "y", "x")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _holes_in_blocks(mask: DataFrame, shape: Shape, most: int) -> DataFrame:
    """``core_holes`` by blocks with ``most`` voxels around them.

    A region that reaches from a block to the end of what it sees has more than ``most`` voxels.
    """
    from filamenta.operators.graph import forest

    inside = mask.select("z", "y", "x").where(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("zyx", shape, strict=True)))
    counts = [-(-n // SIZE) for n in shape]
    of = F.col("id")
    every = mask.sparkSession.range(counts[0] * counts[1] * counts[2]).select(F.expr(f"cast(id div {counts[1] * counts[2]} as int)").alias("bz"), F.expr(f"cast(id div {counts[2]} % {counts[1]} as int)").alias("by"), (of % counts[2]).cast("int").alias("bx"))

    def empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks without a voxel of the mask are all void."""
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = math.prod(hi - lo for lo, hi in _box(shape, SIZE, tuple(key)))
                yield _batch([(*key, np.zeros(n).tobytes() if data is None else data)])

    held = every.join(to_blocks(inside.withColumn("v", F.lit(1.0)), shape), _KEYS, "left").select(*_KEYS, "data").mapInArrow(empty, _BLOCK)

    def solve(seen: np.ndarray) -> np.ndarray:
        """2 beyond the volume, 1 in the mask, 0 void."""
        void, beyond = seen == 0, seen == 2
        found = np.zeros(seen.shape, bool)
        number = np.cumsum(void).reshape(seen.shape) - 1
        n = int(void.sum())
        for axis in range(3):
            i, j, rim = [], [], np.zeros(n, bool)
            for c in (k for k in range(3) if k != axis):
                low, high = [slice(None)] * 3, [slice(None)] * 3
                low[c], high[c] = slice(None, -1), slice(1, None)
                low, high = tuple(low), tuple(high)
                both = void[low] & void[high]
                i.append(number[low][both])
                j.append(number[high][both])
                rim[number[low][void[low] & beyond[high]]] = True
                rim[number[high][void[high] & beyond[low]]] = True
            root = forest(n, np.concatenate(i), np.concatenate(j))
            open_ = np.zeros(n, bool)
            open_[root[rim]] = True
            small = (np.bincount(root, minlength=n) <= most) & ~open_
            found[void] |= small[root]
        cut = tuple(slice(most, k - most) for k in seen.shape)
        return found[cut]

    holes = filtered(held, shape, most, solve, mirror=False, beyond=2.0)
    return to_rows(holes, shape).where("v > 0").select("z", "y", "x")
