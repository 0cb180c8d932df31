"""Contacts of all segments, by blocks: long ones too, copies once, each pair once."""

import random

import duckdb
import pytest

from filamenta import plans
from filamenta.operators import alike, contacts, scoring
from filamenta.sources import adapters as ad

VERTICES = "fiber_id long, seq long, x double, y double, z double"


def network(seed=3):
    rng = random.Random(seed)
    lines = [[(rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([0.0, 1.0, 0.5])) for _ in range(8)] for _ in range(7)]
    lines[2][3] = lines[2][4]  # a segment of no length
    lines[3] = [(-30.0 + 9 * k, 5.0, 0.2) for k in range(8)]  # along an axis, and one beside it
    lines[4] = [(-28.0 + 9 * k, 5.3, 0.2) for k in range(8)]
    of = {1: 0, 2: 1, 3: 2, 5: 3, 7: 4, 11: 5, 13: 6, 20: 0, 21: 1, 22: 0, 30: 3, 31: 4}
    return [(f, k, *p) for f, n in of.items() for k, p in enumerate(lines[n])]


def both(spark, monkeypatch, name, rows=None):
    """Rows of a query over a network with copies, and those of its SQL."""
    rows = rows or network()
    monkeypatch.setattr(ad, "vertices", lambda *_: spark.createDataFrame(rows, VERTICES))
    df = plans.QUERIES[name](spark, "")
    con = duckdb.connect()
    con.execute("CREATE TABLE given (fiber_id BIGINT, seq BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", rows)
    text = plans.ORACLE_SQL[name].replace(ad.VIEWS["vertices"], "SELECT * FROM given").replace(ad.VIEWS["fibers"], "SELECT DISTINCT fiber_id FROM given")
    found = con.execute(text)
    names = [d[0] for d in found.description]
    plain = lambda r: tuple(None if v is None else round(float(v), 5) + 0.0 for v in r)
    return sorted(map(plain, df.select(*names).collect()), key=str), sorted(map(plain, found.fetchall()), key=str)


@pytest.mark.parametrize("name", ["capture_contacts", "junction_candidates", "segment_corrections"])
def test_all_segments_and_copies(spark, monkeypatch, name):
    got, want = both(spark, monkeypatch, name)
    assert got == want and len(want) > 50


@pytest.mark.parametrize("name", ["capture_contacts", "junction_candidates", "segment_corrections"])
def test_long_segments_take_part(spark, monkeypatch, name):
    rows = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 90.0, 0.0, 0.0), (1, 0, 45.0, -30.0, 0.25), (1, 1, 45.0, 30.0, 0.25)]
    monkeypatch.setattr(ad, "vertices", lambda *_: spark.createDataFrame(rows, VERTICES))
    assert plans.QUERIES[name](spark, "").count() > 0
    assert "len <=" not in plans.ORACLE_SQL[name]


def test_corrections_of_copies_are_summed_once(spark, monkeypatch):
    rows = [(f, k, 4.0 * k, 0.3 * y, 0.1 * (k % 2)) for f, y in {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 4}.items() for k in range(6)]
    seen, sums = [], contacts.sums
    monkeypatch.setattr(contacts, "sums", lambda lines, reach: seen.append(lines.count()) or sums(lines, reach))
    got, want = both(spark, monkeypatch, "contact_corrections", rows)
    assert got == want and len(want) == 30 and seen == [15]


@pytest.mark.parametrize("name", ["neighbour_histogram", "neighbour_turnover", "contact_dispersion", "overlap_counts"])
def test_equal_fibers_are_looked_at_once(spark, monkeypatch, name):
    rng = random.Random(5)
    shapes = [[(12.0 * k + rng.uniform(-1, 1), rng.uniform(0, 3), 4.0) for k in range(60)] for _ in range(5)]
    of = {1: 0, 2: 1, 3: 2, 4: 3, 5: 0, 6: 0, 8: 1, 9: 4, 12: 4}
    seen, first_of = [], alike.first_of
    monkeypatch.setattr(alike, "first_of", lambda rows, *a: seen.append(first_of(rows, *a).count()) or first_of(rows, *a))
    got, want = both(spark, monkeypatch, name, [(f, k, *p) for f, n in of.items() for k, p in enumerate(shapes[n])])
    assert got == want and seen == [300]


def test_overlaps_between_samples_are_seen(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 90.0, 0.0, 0.0), (1, 0, 46.3, -30.0, 0.1), (1, 1, 46.3, 31.7, 0.1), (2, 0, 0.0, 9.0, 0.0), (2, 1, 40.0, 9.0, 0.0)], VERTICES)
    r = spark.createDataFrame([(0, 0.25), (1, 0.25), (2, 0.25)], "fiber_id long, radius double")
    row = scoring.geometry_report(v, r, 20.0).first()
    assert row["penetration"] == pytest.approx(1.6) and row["overlapping"] == 1
    assert scoring.geometry_report(v, r, 20.0, step=4.0).first()["overlapping"] == 0
    assert "unnest(range" not in plans.ORACLE_SQL["geometry_report"]
