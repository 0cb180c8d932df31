import numpy as np
from pyspark.sql import functions as F

from filamenta.llm import lsh_forest


def _brute(x, q, k, own):
    s = x @ q
    s[own] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


def test_ranges_are_prefix_matches():
    rng = np.random.default_rng(0)
    f = lsh_forest.Forest(rng.normal(size=(300, 8)), trees=3, bits=20)
    q = rng.normal(size=(4, 8))
    first, last = f.ranges(q)
    unit = np.c_[q / np.linalg.norm(q, axis=1)[:, None], np.zeros(4)]
    for t in range(3):
        for i, code in enumerate(f._code(unit, t)):
            for x in (0, 1, 7, 20):
                want = np.flatnonzero(f.codes[t] >> np.uint64(20 - x) == code >> np.uint64(20 - x))
                assert (first[t, i, x], last[t, i, x]) == ((want[0], want[-1] + 1) if len(want) else (first[t, i, x],) * 2)


def test_recall_isolated_clustered_and_uneven_norms():
    rng = np.random.default_rng(1)
    isolated = rng.normal(size=(6000, 64))
    clustered = rng.normal(size=(6, 64))[rng.integers(0, 6, 6000)] + 0.05 * rng.normal(size=(6000, 64))
    for x in (isolated / np.linalg.norm(isolated, axis=1)[:, None], clustered, isolated * rng.uniform(0.2, 3, (6000, 1))):
        f = lsh_forest.Forest(x)
        at = np.arange(0, 6000, 100)
        found = f.search(x[at], 20, lambda i: [at[i]])
        recall = [np.isin(_brute(x, x[i], 20, i), rows).mean() for i, (rows, _) in zip(at, found, strict=True)]
        assert np.mean(recall) >= 0.9


def test_rows_edge_cases_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "SHARD", 100)
    monkeypatch.setattr(lsh_forest, "QUERIES", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 10)).astype(np.float32)
    x[100:160] = x[7]
    rows = [(int(i), [float(c) for c in v], 0.5) for i, v in enumerate(x)]
    odd = [(901, None, 0.1), (902, [], 0.1), (903, [float("nan")] * 10, 0.1), (904, [None, *[1.0] * 9], 0.1), (None, [1.0] * 10, 0.1), (905, [0.0] * 10, 0.2), (906, [float("inf")] * 10, 0.2), (900, [1.0], 0.0)]
    frame = spark.createDataFrame([*rows, *odd, rows[20]], "vec_id long, embedding array<float>, score double")
    got: dict = {}
    for r in lsh_forest.neighbours(frame, F.col("id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = []
    d = x.astype(float)
    for i, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and i not in [v for _, v, _ in found]
        assert all(abs(s - d[v] @ d[i]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits.append(np.isin(_brute(d, d[i], 20, i), [v for _, v, _ in found]).mean())
    assert np.mean(hits) >= 0.9
    assert [v for _, v, _ in got[100]][:20] == [7, *range(101, 120)]  # equal vectors: ties to smaller ids
    assert lsh_forest.neighbours(frame.limit(0), F.lit(True), 20).count() == 0
    assert lsh_forest.neighbours(spark.createDataFrame(rows[:3], frame.schema), F.lit(True), 20).count() == 6
