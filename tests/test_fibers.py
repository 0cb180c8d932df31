import json
import math

import pytest

from filamenta.operators import distribution, metrics, particles, shape, solver, spatial, volumes
from filamenta.operators import segments as sg
from filamenta.operators import graph
from filamenta.operators.graph import connected_components
from filamenta.sources import fits, lammps

V = "fiber_id long, seq int, x double, y double, z double"


def poly(spark, *lines):
    return spark.createDataFrame([(f, k, *map(float, p)) for f, line in enumerate(lines) for k, p in enumerate(line)], V)


def fibers(spark, *radii):
    return spark.createDataFrame([(f, f, 0, 0, float(r)) for f, r in enumerate(radii)], "fiber_id long, material_id int, section_id int, layer int, radius double")


def test_one_fiber_metrics(spark):
    v = poly(spark, [(1.5, 1, 1), (0.5, 1, 1)])
    names = spark.createDataFrame([(0, "a"), (1, "unused")], "material_id int, name string")
    out = {r["name"]: r for r in metrics.assembly_metrics(v, fibers(spark, 0.1), names, 8.0).collect()}
    assert out["all"].length_xx == 1 and out["all"].length_yy == 0 and abs(out["all"].volume_fraction - math.pi * 0.01 / 8) < 1e-12
    assert out["unused"].fibers == 0 and out["unused"].length_xx == 0


def test_thick_and_thin_tensor(spark):
    v = poly(spark, [(0, 0, 0), (1, 0, 0)], [(0, 0, 0), (0, 1, 0)])
    names = spark.createDataFrame([(0, "thick"), (1, "thin")], "material_id int, name string")
    r = metrics.assembly_metrics(v, fibers(spark, 0.2, 0.1), names, 1.0).where("level = 'total'").first()
    assert (r.length_xx, r.length_yy) == (0.5, 0.5) and abs(r.volume_xx - 0.8) < 1e-12 and abs(r.volume_yy - 0.2) < 1e-12


def test_curvature_of_arc_and_helix(spark):
    arc = [(2 * math.cos(t), 2 * math.sin(t), 0) for t in (math.pi * i / 400 for i in range(401))]
    k = [r.curvature for r in sg.vertex_curvature(poly(spark, arc)).collect()]
    assert all(abs(x - 0.5) < 1e-4 for x in k)
    assert abs(shape.curl(poly(spark, arc)).first().curl - (math.pi / 2 - 1)) < 1e-4
    helix = lambda s: [(math.cos(t), math.sin(t), s * 0.5 * t) for t in (8 * math.pi * i / 4000 for i in range(4001))]
    for side in (1, -1):
        r = shape.sample_curvature(sg.resampled(poly(spark, helix(side)), 0.05), 0.05).groupBy().avg("curvature", "torsion").first()
        assert abs(r[0] - 0.8) < 5e-3 and abs(r[1] - side * 0.4) < 5e-3
    straight = sg.maximum_curvature(poly(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 0, 0), (1, 1, 1)])).collect()
    assert [r.max_curvature for r in straight] == [0, 0]


def test_distribution_and_shift(spark):
    a = spark.createDataFrame([(float(x),) for x in range(100, -1, -1)] + [(float("nan"),), (None,), (float("inf"),)], "v double")
    r = distribution.summary(a, "v").first()
    assert r["count"] == 101 and r.quantiles == [10.0 * i for i in range(11)]
    b = a.selectExpr("v + 2.5 AS v")
    assert abs(distribution.wasserstein(a, b, "v").first().distance - 2.5) < 1e-12


def test_anchors_and_duplicates(spark):
    v = poly(spark, [(0, 0, 0), (1, 0, 0), (1, 0, 0), (4, 0, 0)])
    asked = spark.createDataFrame([(0, 0.5), (0, 1.0), (0, 4.0), (0, 4.5)], "fiber_id long, s double")
    got = sorted((r.s, r.seq, r.px) for r in sg.point_at(v, asked).collect())
    assert got == [(0.5, 0, 0.5), (1.0, 2, 1.0), (4.0, 2, 4.0)]
    assert sg.without_duplicates(v).count() == 3


def line(a, b, n):
    return [tuple(p + (q - p) * i / n for p, q in zip(a, b, strict=True)) for i in range(n + 1)]


def test_orthogonal_contact(spark):
    v = poly(spark, line((0.5, 1, 1), (1.5, 1, 1), 4), line((1, 0.5, 1.1), (1, 1.5, 1.1), 4))
    samples = sg.resampled(v, 0.002).selectExpr("fiber_id", "k", "x AS px", "y AS py", "z AS pz")
    n = spatial.neighbours(samples, sg.segments(v), 0.15, 0.2)
    events = spatial.contact_events(n, 0.002, 0.11).collect()
    assert sorted((e.fiber_id, e.other_id) for e in events) == [(0, 1), (1, 0)]
    assert all(abs(e.length - 2 * math.sqrt(0.11**2 - 0.1**2)) < 0.005 for e in events)
    c = spatial.closest_approach(spatial.segment_pairs(sg.segments(v), 0.15, 0.5)).orderBy("distance").first()
    assert abs(c.distance - 0.1) < 1e-12


def test_free_lengths_of_overlapping_events(spark):
    e = spark.createDataFrame([(0, 9, 0.0, 10.0), (0, 8, 2.0, 1.0), (0, 7, 5.0, 1.0), (0, 6, 12.0, 1.0)], "fiber_id long, other_id long, start double, length double")
    assert [r.gap for r in spatial.free_lengths(e).collect()] == [2.0]


def test_labels_and_distance(spark):
    rows = ["11001", "00001", "10000"]
    mask = spark.createDataFrame([(i, j) for i, r in enumerate(rows) for j, c in enumerate(r) if c == "1"], "row long, col int")
    got = {(r.row, r.col): r.label for r in volumes.labels(mask, 5).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (0, 4): 2, (1, 4): 2, (2, 0): 3}
    image = spark.createDataFrame([(i, j, float(c)) for i, r in enumerate(rows) for j, c in enumerate(r)], "row long, col int, v double")
    d = {(r.row, r.col): r.distance for r in volumes.distance_transform(image, image["v"] > 0).collect()}
    assert d[(1, 0)] == 1 and abs(d[(1, 2)] - math.sqrt(2)) < 1e-12 and d[(2, 4)] == 1


def test_voxel_tie_goes_to_smaller_fiber(spark):
    v = poly(spark, line((0, 0, 0), (1, 0, 0), 1), line((0, 0, 0), (1, 0, 0), 1))
    s = sg.segments(v).withColumn("radius", volumes.F.lit(0.15))
    o = volumes.owners(s, 0.1).collect()
    assert o and {r.fiber_id for r in o} == {0} and {r.claims for r in o} == {2}


def test_spheres_and_bonds(spark):
    v = poly(spark, line((0, 0, 0), (1, 0, 0), 3), line((0, 0, 0), (0.05, 0, 0), 1))
    x = sorted((r.fiber_id, round(r.x, 9)) for r in particles.exact_spheres(v, 0.3).collect())
    assert x == [(0, 0.05), (0, 0.35), (0, 0.65), (0, 0.95), (1, 0.025)]
    assert particles.consecutive_bonds(particles.exact_spheres(v, 0.3), ["k"]).count() == 3
    q = particles.capsules(v, fibers(spark, 0.1, 0.1)).where("fiber_id = 0").first()
    assert abs(q.qw - math.sqrt(0.5)) < 1e-12 and abs(q.qy - math.sqrt(0.5)) < 1e-12


def test_solver_relaxes_a_stretched_fiber(spark):
    v = poly(spark, line((0, 0, 0), (3, 0, 0), 2))
    recipe = solver.Recipe([lambda s: solver.applied(s, solver.internal_corrections(s, 1.0, 0.5, 0.0), 0.5)], settled=1e-2, rounds=12)
    out, rounds = recipe.run(v)
    lengths = [r.len for r in sg.segments(out).collect()]
    assert rounds <= 12 and all(abs(x - 1) < 0.06 for x in lengths)


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_components_of_chains_and_hubs(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)  # the small one goes through all rounds
    edges = [(i, i + 1) for i in range(50, 80)] + [(200, i) for i in range(201, 340)] + [(339, 341), (7, 7), (1, 2), (2, 1), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(50, 81), 50), **dict.fromkeys([*range(200, 340), 341], 200), 1: 1, 2: 1}
    names = [("b", "c"), ("c", "é"), ("x", "y")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(names, "a string, b string").repartition(3), "a", "b").collect()}
    assert got == {"b": "b", "c": "b", "é": "b", "x": "x", "y": "x"}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


DATA = """two chains

6 atoms
4 bonds
1 atom types
1 bond types

0 10 xlo xhi
0 10 ylo yhi
0 10 zlo zhi

Atoms # bpm/sphere

1 1 1 1.0 1.0 8 5 5
2 1 1 1.0 1.0 9 5 5
3 1 1 1.0 1.0 0.5 5 5 1 0 0
4 2 1 1.0 1.0 3 3 3
5 2 1 1.0 1.0 3 4 3
6 2 1 1.0 1.0 3 5 3

Bonds

1 1 1 2
2 1 2 3
3 1 4 5
4 1 5 6
"""


def test_lammps_round_trip(spark, tmp_path):
    (tmp_path / "in.data").write_text(DATA)
    atoms, bonds, header = lammps.read_data(spark, str(tmp_path / "in.data"))
    assert header["atoms"] == 6 and header["x"] == (0.0, 10.0) and bonds.count() == 4
    c = lammps.chains(atoms, bonds)
    assert sorted((r.fiber_id, r.seq, r.id) for r in c.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (4, 1, 5), (4, 2, 6)]
    x = [r.x for r in particles.unwrapped(c, {"x": 10.0}).where("fiber_id = 1").orderBy("seq").collect()]
    assert x == [8, 9, 10.5]
    lammps.write_data(atoms, bonds, header, str(tmp_path / "out"))
    text = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "out").glob("part-*")) if p.stat().st_size)
    (tmp_path / "again.data").write_text(text)
    again, bonds2, h2 = lammps.read_data(spark, str(tmp_path / "again.data"))
    assert again.count() == 6 and bonds2.count() == 4 and h2["z"] == (0.0, 10.0)
    (tmp_path / "bad.data").write_text(DATA.replace("2 1 1 1.0 1.0 9 5 5", "2 1 1 1.0"))
    with pytest.raises(lammps.LammpsError) as e:
        lammps.read_data(spark, str(tmp_path / "bad.data"))
    assert e.value.code == "row_width"


def test_fit_json(spark, tmp_path):
    (tmp_path / "fit.json").write_text(json.dumps({"schema": "x", "voxel_size": 1.0, "shape": [4, 4, 4], "fibers": [{"radius": 1.5, "type": 0, "centerline": [[0, 0, 0], [1, 2, 3]]}]}))
    f, v = fits.load_fit(spark, str(tmp_path / "fit.json"))
    assert f.first().radius == 1.5 and [(r.seq, r.z) for r in v.orderBy("seq").collect()] == [(0, 0.0), (1, 3.0)]


def test_streaming_lengths(spark, tmp_path):
    from filamenta.streaming.vertices import running_lengths

    rows = poly(spark, line((0, 0, 0), (4, 0, 0), 4))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_lengths(stream).writeStream.outputMode("update").format("memory").queryName("lengths").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.vertices, r.length) for r in spark.table("lengths").collect()] == [(5, 4.0)]


def test_persistence_of_straight_and_bent_chains(spark):
    curve = lambda values: spark.createDataFrame(list(enumerate(values, 1)), "lag int, correlation double")
    assert shape.persistence(curve([1.0, 1.0000000000000002, 1.0]), 0.5).first()[0] is None
    assert math.isclose(shape.persistence(curve([math.exp(-k / 4) for k in range(1, 9)]), 1.0).first()[0], 4.0)
    bent = shape.persistence(curve([1.0, math.exp(-1), 0.05, 0.01, 0.5]), 1.0).first()[0]
    assert math.isclose(bent, 14 / (2 + 3 * -math.log(0.05)))
