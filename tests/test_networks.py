import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.functions import random as rnd
from filamenta.operators import baseline, blocks, mixture, numbering, ties, volumes

VERTICES = "fiber_id long, seq long, x double, y double, z double"


def splitmix(seed, n):
    m, state, out = (1 << 64) - 1, seed, []
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & m
        v = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & m
        v = ((v ^ v >> 27) * 0x94D049BB133111EB) & m
        out.append(v ^ v >> 31)
    return out


@pytest.mark.parametrize("seed", [0, 7, (1 << 64) - 3])
def test_splitmix_by_counter(spark, seed):
    n = 300
    got = spark.range(n).select("id", rnd.splitmix(F.col("id"), seed).alias("v"), rnd.unit(F.col("id"), seed).alias("u"), rnd.index(F.col("id"), seed, F.lit(1_000_003)).alias("i")).orderBy("id").collect()
    want = splitmix(seed, n)
    assert [r["v"] % (1 << 64) for r in got] == want
    assert [r["u"] for r in got] == [(w >> 11) / (1 << 53) for w in want] and [r["i"] for r in got] == [w % 1_000_003 for w in want]


def test_numbers_without_a_gap(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i) for i in range(700)]
    got = numbering.numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"]).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(700))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows)
    assert numbering.numbered(spark.createDataFrame([], "a long"), ["a"]).count() == 0


def test_random_baseline(spark):
    rng = random.Random(7)
    rows, lines = [], []
    for f in range(60):
        u = np.array([rng.gauss(0, 1) for _ in range(3)])
        u /= np.linalg.norm(u)
        rows += [(f, k, *map(float, k * 0.5 * u)) for k in range(3)]
        lines += [(f, u)] * 10
    v = spark.createDataFrame(rows, VERTICES)
    r = v.select("fiber_id", F.lit(0.02).alias("radius")).distinct()
    got = baseline.random_baseline(v, r, 0.11, 0.01, 2.0, 4000, 7).first()
    draws = [x % len(lines) for x in splitmix(7, 8000)]
    pairs = [(lines[a], lines[b]) for a, b in zip(draws[::2], draws[1::2]) if lines[a][0] != lines[b][0]]
    want = 2 * (60 * 1.0 / 2.0) * np.mean([0.05 * math.sqrt(1 - min(1, abs(p[1] @ q[1])) ** 2) for p, q in pairs])
    assert got["pairs"] == len(pairs) and got["contacts"] == pytest.approx(want, rel=1e-9)
    for args in ((v.where("fiber_id = 1"), r, 0.1, 0.0, 1.0), (v, r, 0.1, 0.0, 0.0), (v.limit(0), r, 0.1, 0.0, 1.0), (v, r, 0.1, 0.0, 1.0, 0)):
        assert baseline.random_baseline(*args).count() == 0


def test_closest_triangles(spark):
    rng = np.random.default_rng(2)
    tri = rng.uniform(0, 20, (40, 1, 3)) + rng.uniform(-4, 4, (40, 3, 3))
    tri[5, 2] = tri[5, 1]  # flat
    tri[6] = tri[7]  # the same twice
    points = rng.uniform(-3, 23, (150, 3))
    steps = np.linspace(0, 1, 60)
    grid = np.array([(1 - a - b, a, b) for a in steps for b in steps if a + b <= 1 + 1e-12])
    t = spark.createDataFrame([(k, *map(float, x.ravel())) for k, x in enumerate(tri)], "tri long, " + ", ".join(f"{c}{k} double" for k in "123" for c in "xyz"))
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(points)], "id long, x double, y double, z double")
    got = {r["id"]: r for r in ties.nearest(p, t, 0.5).collect()}
    assert len(got) == 150
    for k, q in enumerate(points):
        r = got[k]
        w = np.array([r["w1"], r["w2"], r["w3"]])
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and np.linalg.norm(w @ tri[r["tri"]] - q) == pytest.approx(r["distance"], abs=1e-8)
        best = min(np.linalg.norm(grid @ x - q, axis=1).min() for x in tri)
        assert r["distance"] <= best + 1e-9 and r["distance"] > best - 0.3 and r["tri"] != 7
    near = {r["id"]: r["tri"] for r in ties.within(p, t, 1.5).collect()}
    assert near == {k: r["tri"] for k, r in got.items() if r["distance"] <= 1.5}
    assert ties.nearest(p, t.limit(0), 1.0).count() == 0 and ties.nearest(p.limit(0), t, 1.0).count() == 0


def test_ties_leave_out_the_main_nodes(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.5, 0.5, 0.1), (4, 0.5, 0.5, 3.0)], "node long, x double, y double, z double")
    main = spark.createDataFrame([(9, 0, 1, 2)], "tri long, m1 long, m2 long, m3 long")
    got = ties.constraints(nodes, main, spark.createDataFrame([(0,), (3,), (3,), (4,)], "node long"), 0.5).collect()
    assert [(r["node"], r["m1"], round(r["w1"], 6), round(r["w2"], 6), round(r["w3"], 6)) for r in got] == [(3, 0, 0.5, 0.25, 0.25)]


SHAPE = (11, 6, 17)


def volume(spark, seed=3):
    v = np.random.default_rng(seed).random(SHAPE)
    rows = [(int(z), int(y), int(x), float(v[z, y, x])) for z, y, x in np.ndindex(SHAPE)]
    return v, spark.createDataFrame(rows, "z long, y long, x long, v double").repartition(3)


def dense(rows, name="v"):
    out = np.full(SHAPE, np.nan)
    for r in rows.collect():
        out[r["z"], r["y"], r["x"]] = r[name]
    return out


def smooth(v, sigma, order):
    for axis, o in enumerate(order):
        w = blocks.kernel(sigma, o)
        h = len(w) // 2
        at = blocks.mirrored(np.arange(-h, v.shape[axis] + h), v.shape[axis])
        wide = np.take(v, at, axis=axis)
        v = sum(x * np.take(wide, np.arange(k, k + v.shape[axis]), axis=axis) for k, x in enumerate(w))
    return v


@pytest.mark.parametrize("size", [4, 7, 32])
def test_filters_do_not_depend_on_the_blocks(spark, size):
    v, rows = volume(spark)
    b = blocks.to_blocks(rows, SHAPE, size)
    assert np.array_equal(dense(blocks.to_rows(b, SHAPE, size=size)), v)
    for order in ((0, 0, 0), (1, 0, 2)):
        assert dense(blocks.to_rows(blocks.gaussian(b, SHAPE, 1.3, order, size), SHAPE, size=size)) == pytest.approx(smooth(v, 1.3, order), abs=1e-12)
    h = blocks.to_rows(blocks.hessian(b, SHAPE, 1.3, size), SHAPE, list(blocks.COMPONENTS), size)
    for name, order in blocks.COMPONENTS.items():
        assert dense(h, name) == pytest.approx(1.69 * smooth(v, 1.3, order), abs=1e-12)


def test_kernel_moments():
    x = np.arange(-8, 9)
    assert blocks.kernel(2.0).sum() == pytest.approx(1) and (blocks.kernel(2.0, 1) * x).sum() == pytest.approx(1, rel=0.01) and (blocks.kernel(2.0, 2) * x**2).sum() == pytest.approx(2, rel=0.02)


def test_a_bright_rod_along_x_points_along_x(spark):
    n = 15
    rows = [(k, j, i, math.exp(-((j - 7) ** 2 + (k - 7) ** 2) / 4)) for k in range(n) for j in range(n) for i in range(n)]
    b = blocks.to_blocks(spark.createDataFrame(rows, "z long, y long, x long, v double"), (n, n, n), 6)
    points = spark.createDataFrame([(0, 7.5, 7.5, 7.5), (1, 7.2, 7.9, 7.4), (2, 99.0, 7.0, 7.0)], "id long, px double, py double, pz double")
    got = {r["id"]: r for r in blocks.directions(b, (n, n, n), 1.5, points, 6).collect()}
    assert got[0]["ax"] > 0.99 and got[0]["tubularity"] > 0 and got[1]["ax"] > 0.99 and (got[2]["ax"], got[2]["tubularity"]) == (1.0, 0.0)
    strength = blocks.to_rows(blocks.tube_strength(b, (n, n, n), 1.5, 6), (n, n, n), size=6).where("x = 7").orderBy(F.desc("v")).first()
    assert (strength["y"], strength["z"]) == (7, 7)


def test_core_holes_of_a_ring_and_by_slices(spark):
    ring = [(z, y, x) for z in range(3) for y in range(1, 4) for x in range(1, 4) if (y, x) != (2, 2)]
    got = blocks.core_holes(spark.createDataFrame(ring, "z long, y long, x long"), (3, 5, 5), 4)
    assert sorted((r["z"] * 5 + r["y"]) * 5 + r["x"] for r in got.collect()) == [12, 37, 62]
    rng = np.random.default_rng(7)
    shape, most = (7, 8, 9), 3
    mask = rng.random(shape) < 0.6
    want = np.zeros(shape, bool)
    for axis in range(3):
        for plane, found in zip(np.moveaxis(mask, axis, 0), np.moveaxis(want, axis, 0), strict=True):
            left = {tuple(p) for p in np.argwhere(~plane).tolist()}
            while left:
                region, todo = set(), [left.pop()]
                while todo:
                    p = todo.pop()
                    region.add(p)
                    for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
                        if q in left:
                            left.remove(q)
                            todo.append(q)
                edge = any(a in (0, n - 1) for p in region for a, n in zip(p, plane.shape, strict=True))
                if len(region) <= most and not edge:
                    for p in region:
                        found[p] = True
    got = blocks.core_holes(spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)], "z long, y long, x long"), shape, most)
    assert sorted(tuple(r) for r in got.collect()) == sorted(map(tuple, np.argwhere(want).tolist()))


def plain_em(x, means, rounds):
    n, d = x.shape
    cov = np.cov(x.T, bias=True).reshape(d, d) + mixture.FLOOR * np.eye(d)
    m = mixture.Mixture(np.full(len(means), 1 / len(means)), means, np.array([cov] * len(means)))
    for _ in range(rounds):
        logs = m.log_densities(x)
        resp = np.exp(logs - logs.max(1, keepdims=True))
        resp /= resp.sum(1, keepdims=True)
        nk = resp.sum(0) + 1e-9
        mu = resp.T @ x / nk[:, None]
        covs = np.array([((resp[:, j, None] * (x - mu[j])).T @ (x - mu[j])) / nk[j] + mixture.FLOOR * np.eye(d) for j in range(len(nk))])
        m = mixture.Mixture(nk / nk.sum(), mu, covs)
    return m


def test_mixture_finds_the_types_and_their_number(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0.0, 0.0], [1.2, -1.0], [1.3, 2.0]])
    kind = rng.integers(0, 3, 600)
    x = centres[kind] + rng.normal(0, 0.12, (600, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(600, None, 1.0), (601, float("nan"), 1.0)], "fiber_id long, a double, b double").repartition(4)
    model, mean, dev = mixture.fit(df, ["a", "b"])
    assert len(model.weights) == 3
    got = {r["fiber_id"]: r["type"] for r in mixture.assign(df, ["a", "b"], model, mean, dev).collect()}
    assert got.pop(600) is None and got.pop(601) is None
    order = np.argsort(np.argsort([x[kind == k, 0].mean() for k in range(3)]))
    assert np.mean([got[i] == order[kind[i]] for i in range(600)]) > 0.995
    scaled = (x - x.mean(0)) / x.std(0)
    want = plain_em(scaled, model.means.copy(), 40)
    assert want.means == pytest.approx(model.means, abs=1e-3) and want.covs == pytest.approx(model.covs, abs=2e-3)
    assert len(mixture.fit(df, ["a", "b"], 2)[0].weights) == 2 and len(mixture.fit(df.where("fiber_id = 1"), ["a", "b"])[0].weights) == 1
    with pytest.raises(ValueError):
        mixture.fit(df.where("fiber_id >= 600"), ["a", "b"])


def test_straight_fibers_do_not_bend(spark):
    rows = [(0, k, float(k), 0.0, 0.0) for k in range(0, 101, 50)] + [(1, k, 40 * math.cos(k / 40), 40 * math.sin(k / 40), 0.0) for k in range(120)] + [(2, 0, 1.0, 1.0, 1.0)]
    v = spark.createDataFrame(rows, VERTICES)
    got = {r["fiber_id"]: r for r in mixture.features(v, v.select("fiber_id", F.lit(1.0).alias("radius")).distinct()).collect()}
    assert got[0]["bend"] == pytest.approx(math.log(0.005)) and got[2]["bend"] == pytest.approx(math.log(0.005)) and got[0]["log_radius"] == 0.0
    w = 20 / 40
    sagitta = (1 - math.cos(w / 2)) / (2 * math.sin(w / 2))
    assert math.exp(got[1]["bend"]) - 0.005 == pytest.approx(sagitta, rel=0.02)


@pytest.mark.parametrize("size, share", [(4, 0.1), (8, 0.004), (4, 0.0), (32, 0.5)])
def test_distances_to_the_nearest_site(spark, size, share):
    rng = np.random.default_rng(9)
    mask = rng.random(SHAPE) < share
    rows = spark.createDataFrame([(int(z), int(y), int(x), float(mask[z, y, x])) for z, y, x in np.ndindex(SHAPE)], "z long, y long, x long, v double")
    got = dense(blocks.to_rows(blocks.distance_transform(blocks.to_blocks(rows, SHAPE, size), SHAPE, size), SHAPE, size=size))
    sites = np.argwhere(mask)
    at = np.indices(SHAPE).reshape(3, -1).T
    want = np.full(SHAPE, np.inf) if not len(sites) else np.sqrt(((at[:, None] - sites) ** 2).sum(2).min(1)).reshape(SHAPE)
    assert np.allclose(got, want)


def test_holes_by_blocks_are_those_of_the_whole_volume(spark, monkeypatch):
    rng = np.random.default_rng(6)
    shape = (34, 3, 35)
    mask = rng.random(shape) < 0.7
    rows = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)], "z long, y long, x long")
    near = blocks.core_holes(rows, shape, 3)
    assert "_holes_in_blocks" in blocks.core_holes.__code__.co_names and "Generate" not in near._jdf.queryExecution().toString()
    got = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(blocks, "NEAR", 0)
    assert got == sorted(map(tuple, blocks.core_holes(rows, shape, 3).collect())) and got


def test_blocks_without_a_voxel_of_the_mask_are_void(spark):
    ring = [(z, y, x) for z, y, x in np.ndindex(70, 3, 3) if z == 66 and (y, x) != (1, 1)]
    got = blocks.core_holes(spark.createDataFrame([tuple(map(int, p)) for p in ring], "z long, y long, x long"), (70, 3, 3), 1)
    assert [tuple(r) for r in got.collect()] == [(66, 1, 1)]


def test_voxels_reach_their_block_packed_and_blocks_are_dealt_by_voxels(spark):
    """A shuffled row is a batch's voxels of a block, and equal blocks do not meet in one task as they compress well."""
    rows = spark.range(640 * 64).select(F.lit(0).alias("z"), F.expr("id div 64").alias("y"), F.expr("id % 64").alias("x"), F.lit(1.0).alias("v"))
    made = blocks.to_blocks(rows, (1, 640, 64))
    assert "place" in made._jdf.queryExecution().toString()
    assert blocks._tasks((1, 64_000, 64), 32) == 8 and blocks.to_blocks(rows, (1, 64_000, 64)).rdd.getNumPartitions() == 8
    assert blocks.to_rows(made, (1, 640, 64)).agg(F.sum("v"), F.count("*")).first()[:] == (40960.0, 40960)


def test_distances_of_pixels_that_are_there(spark):
    image = spark.createDataFrame([(0, 0, 1.0), (0, 3, 0.0), (0, 3, 0.0), (2, 0, None)], "row long, col int, v double")
    found = volumes.distance_transform(image, F.col("v") > 0.5)
    assert sorted(map(tuple, found.collect())) == [(0, 0, 0.0), (0, 3, 3.0), (2, 0, 2.0)]
