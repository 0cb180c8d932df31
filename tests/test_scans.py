import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.operators import blocks
from filamenta.sources import scans, snapshots

SHAPE = (9, 5, 7)


def array(kind="f4"):
    v = np.random.default_rng(1).random(SHAPE) * 200
    return v.astype(kind)


def rows(spark, v):
    return spark.createDataFrame([(int(z), int(y), int(x), float(v[z, y, x])) for z, y, x in np.ndindex(v.shape)], "z long, y long, x long, v double")


def dense(df, shape=SHAPE):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["z"], r["y"], r["x"]])
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


@pytest.mark.parametrize("kind", ["Float32", "Float64", "UInt8", "Int16"])
def test_vti_round_trip_in_slabs(spark, tmp_path, kind):
    v = array(scans.VTK_TYPES[kind])
    path = str(tmp_path / "v.vti")
    scans.write_vti(rows(spark, v).repartition(4), path, SHAPE, kind, 0.5, (1.0, 2.0, 3.0))
    df, scan = scans.read_scan(spark, path, slab=2 * scans.describe(path).slice_bytes)
    assert scan.shape == SHAPE and scan.spacing == (0.5,) * 3 and scan.origin == (1.0, 2.0, 3.0)
    assert df.rdd.getNumPartitions() == 5 and np.array_equal(dense(df), v.astype(float))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v.vti"]  # nothing is left beside it
    assert np.array_equal(dense(blocks.to_rows(blocks.to_blocks(df, SHAPE, 4), SHAPE, size=4)), v.astype(float))


def test_numpy_metaimage_and_raw(spark, tmp_path):
    v = array("i2")
    np.save(tmp_path / "v.npy", v)
    (tmp_path / "v.raw").write_bytes(b"head" + v.astype(">i2").tobytes())
    head = "ObjectType = Image\nNDims = 3\nDimSize = 7 5 9\nElementType = MET_SHORT\nElementSpacing = 0.1 0.1 0.1\n"
    (tmp_path / "v.mhd").write_text(head + "BinaryDataByteOrderMSB = True\nHeaderSize = -1\nElementDataFile = v.raw\n")
    (tmp_path / "v.mha").write_bytes(head.encode() + b"ElementDataFile = LOCAL\n" + v.tobytes())
    for name, options in (("v.npy", {}), ("v.mhd", {}), ("v.mha", {}), ("v.raw", {"shape": "9,5,7", "dtype": ">i2", "offset": 4})):
        df, scan = scans.read_scan(spark, str(tmp_path / name), **options)
        assert scan.shape == SHAPE and np.array_equal(dense(df), v.astype(float)), name


def test_a_range_of_slices_is_read_alone(spark, tmp_path):
    v = array()
    np.save(tmp_path / "v.npy", v)
    read = lambda **kw: scans.read_scan(spark, str(tmp_path / "v.npy"), slab=1, **kw)[0]
    part = read(first=3, last=6)
    assert part.rdd.getNumPartitions() == 3 and part.agg(F.sum("v")).first()[0] == pytest.approx(v[3:6].astype(float).sum())
    assert read().rdd.getNumPartitions() == 9 and read(first=20).count() == 0 and read(first=7, last=99).count() == 70
    whole = read()
    assert whole.where("z = 4").count() == 35 and whole.where("z in (2, 5)").count() == 70 and whole.count() == 315


@pytest.mark.parametrize(
    "code, name, data, options",
    [
        ("missing", "gone.npy", None, {}),
        ("format", "v.png", b"x", {}),
        ("place", "s3://bucket/v.npy", None, {}),
        ("raw", "v.raw", b"x", {"shape": "1,1,1"}),
        ("size", "v.raw", b"xyz", {"shape": "1,1,4", "dtype": "u1"}),
        ("format", "v.npy", b"nothing", {}),
        ("compressed", "v.mha", b"DimSize = 1 1 1\nElementType = MET_UCHAR\nCompressedData = True\nElementDataFile = LOCAL\nx", {}),
        ("type", "v.mha", b"DimSize = 1 1\nElementType = MET_UCHAR\nElementDataFile = LOCAL\nx", {}),
        ("format", "v.vti", b"<VTKFile>", {}),
    ],
)
def test_refusals(spark, tmp_path, code, name, data, options):
    if data is not None:
        (tmp_path / name).write_bytes(data)
    with pytest.raises(scans.ScanError) as e:
        scans.read_scan(spark, name if "://" in name else str(tmp_path / name), **options)
    assert e.value.code == code


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(0, 0, 0, 1.0), (99, 0, 0, 1.0)], "z long, y long, x long, v double")
    with pytest.raises(Exception, match="outside"):
        scans.write_vti(bad, str(tmp_path / "v.vti"), SHAPE)
    assert list(tmp_path.iterdir()) == []
    scans.write_vti(rows(spark, array()).limit(0), str(tmp_path / "v.vti"), SHAPE)
    assert dense(scans.read_scan(spark, str(tmp_path / "v.vti"))[0]).sum() == 0
    with pytest.raises(Exception, match="exists"):
        scans.write_vti(rows(spark, array()), str(tmp_path / "v.vti"), SHAPE)
    scans.write_vti(rows(spark, array()), str(tmp_path / "v.vti"), SHAPE, overwrite=True)
    assert np.array_equal(dense(scans.read_scan(spark, str(tmp_path / "v.vti"))[0]), array().astype(float))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    v = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [], "b")], "id long, x array<double>, s string")
    first = snapshots.save_snapshot({"v": v, "none": v.limit(0)}, root, "case", 5, {"step": 2})
    tables, manifest = snapshots.load_snapshot(spark, root, "case")
    assert sorted(map(str, tables["v"].collect())) == sorted(map(str, v.collect())) and tables["none"].count() == 0 and manifest["facts"] == {"step": 2}
    second = snapshots.save_snapshot({"v": v.where("id = 1")}, root, "case", 6)
    third = snapshots.save_snapshot({"v": v.union(v)}, root, "case", 7)
    folders = sorted(p.name for p in (tmp_path / "snap").iterdir() if p.is_dir())
    assert folders == sorted([second, third]) and first not in folders
    assert snapshots.load_snapshot(spark, root, "case")[0]["v"].count() == 4 and snapshots.load_snapshot(spark, root, "case", second)[0]["v"].count() == 1

    def refused(code, **kw):
        with pytest.raises(snapshots.SnapshotError) as e:
            snapshots.load_snapshot(spark, **({"root": root, "case": "case"} | kw))
        assert e.value.code == code

    refused("case", case="other")
    refused("missing", root=str(tmp_path / "nowhere"))
    v.write.mode("append").parquet(f"{root}/{third}/v")
    refused("damaged")
    file = tmp_path / "snap" / third / "manifest.json"
    (file.parent / ".manifest.json.crc").unlink()
    file.write_text(json.dumps(json.loads(file.read_text()) | {"schema": 2}))
    refused("schema")
    with pytest.raises(snapshots.SnapshotError):
        snapshots.save_snapshot({}, root, "case")


def test_when_a_run_saves():
    assert [i for i in range(12) if snapshots.due(i, None, 4)] == [4, 5, 6, 7, 8, 9, 10, 11]
    assert snapshots.due(8, 7, 4) and not snapshots.due(7, 4, 4) and snapshots.due(7, 4, 4, True) and not snapshots.due(7, 7, 4, True) and not snapshots.due(0, None, 1, True)
