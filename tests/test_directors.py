import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.operators import directors, distribution, numbering, scoring, volumes

VERTICES = "fiber_id long, seq long, x double, y double, z double"


def tangents(p):
    out = []
    for i in range(len(p)):
        d = p[min(i + 1, len(p) - 1)] - p[max(i - 1, 0)]
        n = np.linalg.norm(d)
        out.append(d / n if n > 0 else np.array([1.0, 0, 0]))
    return out


def flat(t):
    f = np.cross([0, 0, 1.0], t)
    return f / np.linalg.norm(f) if np.linalg.norm(f) > 1e-9 else np.array([1.0, 0, 0])


def across(d, t):
    o = d - (d @ t) * t
    return o / np.linalg.norm(o) if np.linalg.norm(o) > 1e-9 * np.linalg.norm(d) else flat(t)


def aligned(ds):
    for i in range(1, len(ds)):
        if round(float(ds[i - 1] @ ds[i]), 12) < 0:
            ds[i] = -ds[i]
    return ds


def network():
    rng = random.Random(8)
    square = [(0, k, *p) for k, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, -1.0, 0.0)])]
    upright = [(1, k, 2.0, 2.0, float(k)) for k in range(4)] + [(2, 0, 1.0, 1.0, 1.0)] + [(3, k, 1.0, 1.0, 1.0) for k in range(3)]
    return square + upright + [(4 + f, k, *(rng.uniform(-5, 5) for _ in "xyz")) for f in range(6) for k in range(12)]


def found(df):
    out = {}
    for r in df.orderBy("fiber_id", "seq").collect():
        out.setdefault(r["fiber_id"], []).append([r["dx"], r["dy"], r["dz"]])
    return out


def test_directors_as_one_after_another(spark):
    rows = network()
    v = spark.createDataFrame(rows, VERTICES)
    rng = random.Random(9)
    given = {(r[0], r[1]): [rng.uniform(-1, 1) for _ in "xyz"] for r in rows if rng.random() < 0.9}
    d = spark.createDataFrame([(*k, *map(float, x)) for k, x in given.items()], "fiber_id long, seq long, dx double, dy double, dz double")
    own, turned = found(directors.default_directors(v)), found(directors.orthonormalized(v, d))
    for f in own:
        p = [np.array(r[2:]) for r in rows if r[0] == f]
        t = tangents(p)
        assert np.allclose(own[f], aligned([flat(x) for x in t]), atol=1e-9)
        assert np.allclose(turned[f], aligned([across(np.array(given.get((f, k), [0.0, 0, 0])), x) for k, x in enumerate(t)]), atol=1e-9)
    ready = directors.default_directors(v)
    assert directors.invalid(v, ready).count() == 0
    bad = ready.withColumn("dx", F.when((F.col("fiber_id") == 4) & (F.col("seq") < 3), float("nan")).otherwise(F.col("dx")))
    assert [tuple(r) for r in directors.invalid(v, bad).collect()] == [(4, 3)]


def test_geometry_report(spark):
    line = [(0, k, 5.0 * k, 0.0, 0.0) for k in range(9)]
    radii = spark.createDataFrame([(0, 2.0), (1, 2.0), (2, 1.0)], "fiber_id long, radius double")
    beside = line + [(1, k, 5.0 * k, 3.0, 0.0) for k in range(9)] + [(2, 0, 500.0, 0.0, 0.0)]
    r = scoring.geometry_report(spark.createDataFrame(beside, VERTICES), radii, 20.0).first()
    assert r["fibers"] == 2 and r["penetration"] == pytest.approx(0.5) and r["overlapping"] == 1 and r["over_limit"] == 0 and r["segment_cv"] == 0 and r["min_segment"] == 1.25 and r["length"] == 80.0
    bent = [(f, k, x, 4.0 if k == 4 else y, z) for f, k, x, y, z in line] + [(1, k, 5.0 * k, 20.0, 0.0) for k in range(9)]
    r = scoring.geometry_report(spark.createDataFrame(bent, VERTICES), radii, 20.0).first()
    assert r["over_limit"] == 1 and r["penetration"] == 0 and r["ratio_max"] > 1
    assert scoring.geometry_report(spark.createDataFrame([], VERTICES), radii, 1.0).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 500), np.round(rng.normal(0, 2, 500), 1), strict=True)] + [(5, 1.5)] + [(0, math.nan), (0, math.inf), (None, 2.0), (None, 4.0)] + [(1, 7.0)] * 300
    df = spark.createDataFrame(values, "k long, v double").repartition(7)
    shares = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r["k_"], r["k"]): r["q"] for r in distribution.quantiles(df.withColumnRenamed("k", "k_"), "v", shares, ["k_"]).collect()}
    for key in (0, 1, 2, 5, None):
        own = [v for k, v in values if k == key and math.isfinite(v)]
        assert [got[key, i] for i in range(len(shares))] == pytest.approx([float(np.quantile(own, s)) for s in shares])
    every = [r["q"] for r in distribution.quantiles(df, "v", shares).orderBy("k").collect()]
    assert every == pytest.approx([float(np.quantile([v for _, v in values if math.isfinite(v)], s)) for s in shares])
    assert distribution.quantiles(df.limit(0), "v", shares).count() == 0


def test_cumulative_sums(spark):
    rng = random.Random(2)
    rows = [(k, v, rng.randrange(5)) for k in (1, 2, 9) for v in range(rng.randrange(1, 80))]
    got = numbering.cumulative(spark.createDataFrame(rows, "k long, v long, n long").repartition(5), ["v"], "n", ["k"]).collect()
    for r in got:
        assert r["before"] == sum(n for k, v, n in rows if k == r["k"] and v < r["v"])


def test_owners_list_what_a_slanting_segment_meets(spark):
    rng = np.random.default_rng(4)
    segs = [(int(i % 5), *map(float, rng.uniform(-6, 6, 6)), float(rng.uniform(0.3, 2))) for i in range(25)] + [(7, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.8), (8, 0.0, -9.0, 0.0, 0.0, 9.0, 0.0, 0.5)]
    df = spark.createDataFrame(segs, "fiber_id long, x double, y double, z double, x2 double, y2 double, z2 double, radius double")
    size = 0.75
    grid = np.stack(np.meshgrid(*[np.arange(-16, 17)] * 3, indexing="ij"), -1).reshape(-1, 3)
    centre, want = (grid + 0.5) * size, {}
    for f, *p, r in segs:
        a, b = np.array(p[:3]), np.array(p[3:])
        d = b - a
        t = np.clip((centre - a) @ d / max(d @ d, 1e-300), 0, 1)
        signed = np.round(np.linalg.norm(centre - a - t[:, None] * d, axis=1) - r, 6)
        for k in np.flatnonzero(signed <= 0):
            want.setdefault(tuple(grid[k].tolist()), []).append((float(signed[k]), f))
    got = {(r["vx"], r["vy"], r["vz"]): (r["signed"], r["fiber_id"], r["claims"]) for r in volumes.owners(df, size).collect()}
    assert got == {k: (*min(v), len({f for _, f in v})) for k, v in want.items()}


@pytest.mark.parametrize("beta", [0.2, 1.0, 5.0])
def test_the_axial_model_is_fitted(spark, beta):
    from filamenta.operators import shape

    u = (np.arange(4000) + 0.5) / 4000
    c = u / np.sqrt(beta**2 - (beta**2 - 1) * u * u)  # quantiles of the model
    df = spark.createDataFrame([(float(x),) for x in c] + [(None,), (math.nan,)], "c double")
    n, found = shape.schladitz_fit(df, "c")

    def likelihood(x):
        return len(c) * x - 1.5 * np.log1p((math.exp(2 * x) - 1) * c * c).sum()

    assert n == 4000 and found == pytest.approx(beta, rel=0.01)
    assert likelihood(math.log(found)) >= max(likelihood(math.log(found) + d) for d in (-1e-4, 1e-4))
    edge = [shape.schladitz_fit(spark.createDataFrame([(x,)] * 5, "c double"), "c")[1] for x in (0.0, 1.0)]
    assert edge == [math.exp(12), math.exp(-12)] and shape.schladitz_fit(df.limit(0), "c") == (0, None)


def test_axes_and_interior_ends(spark):
    from filamenta.operators import axes

    rows = network()
    got = {r["fiber_id"]: np.array([r["ax"], r["ay"], r["az"]]) for r in axes.fiber_axes(spark.createDataFrame(rows, VERTICES)).collect()}
    for f in got:
        d = np.diff(np.array([r[2:] for r in rows if r[0] == f]).reshape(-1, 3), axis=0)
        n = np.linalg.norm(d, axis=1)
        if n.sum() == 0:
            assert got[f].tolist() == [1.0, 0.0, 0.0]
            continue
        d, n = d[n > 0], n[n > 0]
        values, vectors = np.linalg.eigh((d.T / n) @ d)
        if values[2] - values[1] > 1e-6:
            assert abs(got[f] @ vectors[:, 2]) == pytest.approx(1) and got[f][np.argmax(np.abs(got[f]))] > 0
    radii = spark.createDataFrame([(f, 1.0) for f in range(10)], "fiber_id long, radius double")
    v = spark.createDataFrame([(0, 0, 1.5, 5.0, 5.0), (0, 1, 9.0, 5.0, 5.0), (1, 0, 1.4, 5.0, 5.0), (1, 3, 8.5, 5.0, 8.5)], VERTICES)
    assert sorted(map(tuple, axes.interior_ends(v, radii, (0.0,) * 3, (10.0,) * 3).collect())) == [(0, True, False), (1, False, True)]
