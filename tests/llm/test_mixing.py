import pytest
from pyspark.sql import functions as F

from filamenta.llm import mixing


def test_rake_meets_every_marginal():
    cells = {(a, b, c): 1.0 + 7 * i + 3 * j * j + k for i, a in enumerate("xyz") for j, b in enumerate("pq") for k, c in enumerate("mn")}
    goal = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.6, "q": 0.4}, {"m": 0.1, "n": 0.9}]
    f = mixing.rake(cells, goal)
    total = sum(cells[c] * f[c] for c in cells)
    for axis, target in enumerate(goal):
        for v, share in target.items():
            assert abs(sum(cells[c] * f[c] for c in cells if c[axis] == v) / total - share) < 1e-6


def test_rake_without_goal_for_a_value():
    f = mixing.rake({("x",): 2.0, ("y",): 3.0}, [{"x": 1.0, "absent": 1.0}])
    assert f == {("x",): 1.0, ("y",): 0.0}


def test_mixed_rows_nulls_ties_and_names(spark):
    rows = [(i, "w " * (i % 300), None if i % 50 == 0 else "big" if i % 3 else f"s{i % 7}", "en" if i % 4 else None, 0.5) for i in range(3000)]
    rows += [(None, None, None, None, 0.1), (4, "w " * 4, "big", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep_probability double")
    out = mixing.mixed(docs)
    assert out.count() == len(rows)
    cells = mixing.cell_weights(docs, [F.col("source"), F.col("lang"), mixing.topic_of(F.col("text"))], mixing.token_weight(F.col("text")))
    goal = mixing.tempered(cells, 0)
    w = mixing.token_weight(F.col("text")) * F.col("keep_probability")
    got = {r[0] or mixing.NULL: r[1] for r in out.groupBy("source").agg(F.sum(w)).collect()}
    total = sum(got.values())
    assert all(abs(got[v] / total - share) < 1e-6 for v, share in goal.items())
    kept = out.where("kept").count()
    assert abs(kept - out.agg(F.sum("keep_probability")).first()[0]) < 150
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_null_keys_are_drawn_by_row_and_clashing_columns_stay(spark):
    rows = [(None, f"w{i} " * 50, "big" if i % 10 else "small", "en", "mine", i) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string, cell long")
    out = mixing.mixed(docs)
    expected = out.agg(F.sum("keep_probability")).first()[0]
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and {r.kept for r in kept.select("kept").distinct().collect()} == {"mine"}
    assert expected < 1990 and abs(kept.count() - expected) < 100


def test_targets_that_cannot_be_met_are_warned_of():
    with pytest.warns(UserWarning):
        mixing.rake({("x", "p"): 1.0, ("y", "q"): 1.0}, [{"x": 0.5, "y": 0.5}, {"p": 0.9, "q": 0.1}])


def test_sample_against_plain_python(spark):
    """Weights, raking and probabilities once more in plain Python, from the definition."""
    rows = [(i, "w " * (1 + i * 7 % 400), f"s{i % 3 if i % 4 else 0}", "en" if i % 5 else "de") for i in range(600)]
    got = {r.doc_id: r.keep_probability for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    cell = {i: (s, g, "short" if t.count(" ") < 100 else "prose") for i, t, s, g in rows}
    weight = {i: t.count(" ") + 1 for i, t, _, _ in rows}
    fit = dict.fromkeys(cell, 1.0)
    total = sum(weight.values())
    shares = []
    for axis in range(3):
        sums = {v: sum(weight[i] for i in cell if cell[i][axis] == v) / total for v in {c[axis] for c in cell.values()}}
        tempered = {v: s**mixing.TEMPERATURE for v, s in sums.items()}
        shares.append({v: s / sum(tempered.values()) for v, s in tempered.items()})
    for _ in range(200):
        for axis in range(3):
            sums = {v: sum(weight[i] * fit[i] for i in cell if cell[i][axis] == v) for v in shares[axis]}
            fit = {i: f * shares[axis][cell[i][axis]] * total / sums[cell[i][axis]] for i, f in fit.items()}
    most = max(fit.values())
    assert all(abs(got[i] - fit[i] / most) < 1e-6 for i in fit)
