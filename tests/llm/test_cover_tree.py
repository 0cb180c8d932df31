import numpy as np
from pyspark.sql import functions as F

from filamenta.llm import cover_tree


def _vectors(rng, n, d=12):
    hot = rng.normal(size=d)
    x = rng.normal(size=(n, d))
    x[: n // 3] = hot + 0.01 * rng.normal(size=(n // 3, d))
    x[n // 3 : n // 2] = rng.normal(size=d)  # equal rows
    return x.astype(np.float32)


def _brute(ids, x, asked, k):
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in np.flatnonzero(asked):
        s = z @ z[i]
        rows = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        want += [(int(ids[i]), r + 1, v, -s) for r, (s, v) in enumerate(rows)]
    return sorted(want)


def test_trees_hold_all_rows_and_prune_rightly():
    rng = np.random.default_rng(1)
    z = np.floor(256 * _vectors(rng, 700)).astype(float)
    tree = cover_tree.Tree(z)
    assert sorted(tree.order) == list(range(700)) and len(tree.nodes) > 5
    for c, _, r, a, b, _ in tree.nodes:
        assert np.sqrt(((z[tree.order[a:b]] - c) ** 2).sum(1)).max() <= r + 1e-9
    big = np.full((3, 4), 2.0**40)
    assert cover_tree._products(np.full((1, 4), 3.0), big).tolist() == [[3 * 4 * 2**40] * 3]


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "CHUNK", 60)
    monkeypatch.setattr(cover_tree, "QUERIES", 7)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    monkeypatch.setattr(cover_tree, "BATCH", 4)
    rng = np.random.default_rng(2)
    x, ids = _vectors(rng, 400), np.arange(400) * 7 - 50
    rows = [(int(i), [float(c) for c in v], 0.5) for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None, 0.1), (9002, [], 0.1), (9003, [float("nan")] * 12, 0.1), (9004, [None, *[1.0] * 11], 0.1), (None, [1.0] * 12, 0.1), (9005, [1.0], 0.2), (9006, [float("inf")] * 12, 0.2)]
    frame = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<float>, score double")
    got = cover_tree.top_k(frame, F.col("id") % 5 == 0, 6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _brute(ids, x, ids % 5 == 0, 6)
    few = spark.createDataFrame(rows[:3], frame.schema)
    assert sorted(map(tuple, cover_tree.top_k(few, F.lit(True), 6).collect())) == _brute(ids[:3], x[:3], ids[:3] == ids[:3], 6)
    assert cover_tree.top_k(frame.limit(0), F.lit(True), 6).count() == 0
