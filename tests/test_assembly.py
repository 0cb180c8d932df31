from filamenta.operators import assembly


def test_each_fault_and_what_is_taken(spark):
    lines = "fiber_id long, seq long, x double, y double, z double"
    old = spark.createDataFrame([(1, 0, 0)], "fiber_id long, material_id int, section_id int")
    old_v = spark.createDataFrame([(1, k, *(float(k),) * 6) for k in range(2)], "fiber_id long, seq long, rx double, ry double, rz double, x double, y double, z double")
    new = [(2, 0, 0), (3, 0, 0), (4, 0, 0), (1, 0, 0), (5, 9, 0), (6, 0, 9), (7, None, 0), (8, 0, 0), (8, 1, 0), (None, 0, 0), (9, 1, 0)]
    rest = [(f, 3 * k, float(k), 0.0, 0.0) for f in (1, 2, 3, 5, 6, 7, 8, 9) for k in range(3)] + [(4, 0, 0.0, 0.0, 0.0)]
    placed = [(f, k, x + 5, y, z) for f, k, x, y, z in rest if (f, k) != (3, 6)]
    kinds, sections = spark.createDataFrame([(0,), (1,), (None,)], "material_id int"), spark.createDataFrame([(0,)], "section_id int")
    fibers, vertices, refused = assembly.add_fibers(old, old_v, spark.createDataFrame(new, old.schema), spark.createDataFrame(rest, lines), spark.createDataFrame(placed, lines), kinds, sections)
    assert sorted((r["fiber_id"] or 0, r["fault"]) for r in refused.collect()) == [
        (0, "too_few_vertices"), (1, "duplicate_fiber_id"), (3, "geometry_length_mismatch"), (4, "too_few_vertices"), (5, "unknown_material"), (6, "unknown_section"), (7, "unknown_material"), (8, "duplicate_fiber_id"), (8, "duplicate_fiber_id"),
    ]
    assert sorted(r["fiber_id"] for r in fibers.collect()) == [1, 2, 9]
    got = sorted(map(tuple, vertices.where("fiber_id = 2").collect()))
    assert got == [(2, k, float(k), 0.0, 0.0, float(k) + 5, 0.0, 0.0) for k in range(3)] and vertices.count() == 8
    none = assembly.add_fibers(old, old_v, spark.createDataFrame([], old.schema), spark.createDataFrame([], lines), spark.createDataFrame([], lines), kinds, sections)
    assert none[0].count() == 1 and none[2].count() == 0
