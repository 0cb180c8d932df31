"""Volumes in files: VTI, NumPy, MetaImage and raw data as rows (z, y, x, v), and a VTI writer.

A Python data source. The header (text, or a few hundred bytes) is read when a plan is made; the voxels are planned as slabs
of whole slices, SLAB bytes at most (one slice at least), and each task reads its own byte range. ``first`` and ``last`` name
the slices to read; filters are not pushed into the source, as a pushed filter stays with a DataFrame that is used again. The writer puts each task's voxels at their place in one file beside the target, which takes
the target's name only when every task is done. Files are on a mount that all workers see.

Uncompressed data only; what cannot be read is refused when the plan is made, with a stable code. Voxels that are not written
are 0; a voxel outside the shape is an error, and of one given twice either stays.
"""

from __future__ import annotations

import ast
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SLAB, ROWS = 16 << 20, 1 << 20
#: Names of number types in the formats: fixed values.
VTK_TYPES = {"UInt8": "u1", "Int8": "i1", "UInt16": "u2", "Int16": "i2", "UInt32": "u4", "Int32": "i4", "UInt64": "u8", "Int64": "i8", "Float32": "f4", "Float64": "f8"}
META_TYPES = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
APPENDED = b'<AppendedData encoding="raw">'
#: Bytes in which a header ends.
HEADER = 1 << 16


class ScanError(ValueError):
    """A file that cannot be read or written; ``code`` is stable."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass(frozen=True)
class Scan:
    """Where a file's voxels are: shape (z, y, x), number type, first byte, and spacing and origin (x, y, z) if it says."""

    path: str
    shape: tuple[int, int, int]
    dtype: str
    offset: int
    spacing: tuple[float, ...] = ()
    origin: tuple[float, ...] = ()

    @property
    def slice_bytes(self) -> int:
        return self.shape[1] * self.shape[2] * np.dtype(self.dtype).itemsize


def _numbers(text: str) -> list[float]:
    return [float(v) for v in text.split()]


def _vti(path: Path, head: bytes, array: str | None) -> Scan:
    at = head.find(APPENDED)
    start = head.find(b"_", at)
    if at < 0 or start < 0:
        raise ScanError("format", f"{path} has no raw appended data")
    text = head[:at].decode()
    if 'compressor="' in text:
        raise ScanError("compressed", f"{path} is compressed")
    field = lambda name, s=text: (m := re.search(rf'{name}="([^"]*)"', s)) and m[1]
    extent = [int(v) for v in (field("WholeExtent") or "").split()]
    arrays = re.findall(r"<DataArray[^>]*>", text.split("<CellData", 1)[-1])
    named = next((a for a in arrays if array is None or field("Name", a) == array), None)
    if len(extent) != 6 or named is None:
        raise ScanError("format", f"{path} has no {'cell data' if array is None else array}")
    kind = VTK_TYPES.get(field("type", named) or "")
    if kind is None or int(field("NumberOfComponents", named) or 1) != 1:
        raise ScanError("type", f"{named} is not a number a voxel")
    size = 4 if (field("header_type") or "UInt32") == "UInt32" else 8
    order = ">" if field("byte_order") == "BigEndian" else "<"
    shape = (extent[5] - extent[4], extent[3] - extent[2], extent[1] - extent[0])
    spacing, origin = (tuple(_numbers(field(n) or d)) for n, d in (("Spacing", "1 1 1"), ("Origin", "0 0 0")))
    return Scan(str(path), shape, order + kind, start + 1 + int(field("offset", named) or 0) + size, spacing, origin)


def _npy(path: Path, head: bytes) -> Scan:
    if head[:6] != b"\x93NUMPY":
        raise ScanError("format", f"{path} is not a NumPy array")
    wide = head[6] >= 2
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    start = 12 if wide else 10
    says = ast.literal_eval(head[start : start + size].decode("latin1"))
    if len(says["shape"]) != 3 or says["fortran_order"] or np.dtype(says["descr"]).kind not in "iufb":
        raise ScanError("type", f"{path} is not a three-dimensional array of numbers in C order")
    return Scan(str(path), tuple(says["shape"]), says["descr"], start + size)


def _meta(path: Path, head: bytes) -> Scan:
    fields, at = {}, 0
    for line in head.split(b"\n"):
        at += len(line) + 1
        name, _, value = line.decode("latin1").partition("=")
        fields[name.strip()] = value.strip()
        if name.strip() == "ElementDataFile":
            break
    dims = [int(v) for v in fields.get("DimSize", "").split()]
    kind = META_TYPES.get(fields.get("ElementType", ""))
    if len(dims) != 3 or kind is None or int(fields.get("ElementNumberOfChannels") or 1) != 1:
        raise ScanError("type", f"{path} is not one number a voxel in three dimensions")
    if fields.get("CompressedData", "").lower() == "true":
        raise ScanError("compressed", f"{path} is compressed")
    order = ">" if (fields.get("BinaryDataByteOrderMSB") or fields.get("ElementByteOrderMSB") or "").lower() == "true" else "<"
    name, shape = fields.get("ElementDataFile", ""), (dims[2], dims[1], dims[0])
    if name.upper().startswith("LIST") or "%" in name or not name:
        raise ScanError("format", f"{path} keeps its slices in several files")
    local = name.upper() == "LOCAL"
    source = path if local else path.parent / name
    offset = at if local else int(fields.get("HeaderSize") or 0)
    if offset < 0:
        offset = source.stat().st_size - int(np.prod(shape)) * np.dtype(kind).itemsize
    return Scan(str(source), shape, order + kind, offset, tuple(_numbers(fields.get("ElementSpacing") or fields.get("ElementSize") or "")), tuple(_numbers(fields.get("Offset") or fields.get("Position") or "")))


def _local(path: str) -> Path:
    """The path on the mount; a URL of another store is refused."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ScanError("place", f"{path} is not on a mount")
    return Path(url.path)


def describe(path: str, shape: str | None = None, dtype: str | None = None, offset: int = 0, array: str | None = None) -> Scan:
    """The scan in a file. Raw data need a ``shape`` ("z,y,x") and a ``dtype`` (as NumPy writes it)."""
    file = _local(path)
    if not file.is_file():
        raise ScanError("missing", f"{file} is not a file")
    with open(file, "rb") as f:
        head = f.read(HEADER)
    if shape or dtype:
        if not (shape and dtype) or len(shape.split(",")) != 3:
            raise ScanError("raw", "raw data need a shape z,y,x and a number type")
        scan = Scan(str(file), tuple(int(v) for v in shape.split(",")), np.dtype(dtype).str, offset)
    elif (kind := file.suffix.lower()) == ".vti":
        scan = _vti(file, head, array)
    elif kind == ".npy":
        scan = _npy(file, head)
    elif kind in (".mhd", ".mha"):
        scan = _meta(file, head)
    else:
        raise ScanError("format", f"{file.name}: VTI, NumPy and MetaImage files are read, and raw data with a shape and a number type")
    if not Path(scan.path).is_file():
        raise ScanError("missing", f"{scan.path} is not there")
    if min(scan.shape) < 1 or os.path.getsize(scan.path) < scan.offset + scan.shape[0] * scan.slice_bytes:
        raise ScanError("size", f"{scan.path} is too short for {' x '.join(map(str, scan.shape))} voxels")
    return scan


@dataclass
class Slab(InputPartition):
    first: int
    last: int


class ScanReader(DataSourceReader):
    """Slabs of whole slices, of those asked for."""

    def __init__(self, scan: Scan, slab: int, first: int, last: int | None):
        self.scan, self.slab = scan, slab
        self.low, self.high = max(0, first), scan.shape[0] if last is None else min(last, scan.shape[0])

    def partitions(self) -> list[InputPartition]:
        step = max(1, self.slab // self.scan.slice_bytes)
        return [Slab(z, min(z + step, self.high)) for z in range(self.low, self.high, step)] or [Slab(0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        _, ny, nx = self.scan.shape
        dtype = np.dtype(self.scan.dtype)
        rows = max(1, ROWS // nx)
        with open(self.scan.path, "rb") as f:
            for z in range(partition.first, partition.last):
                for y in range(0, ny, rows):
                    n = min(rows, ny - y)
                    f.seek(self.scan.offset + z * self.scan.slice_bytes + y * nx * dtype.itemsize)
                    v = np.frombuffer(f.read(n * nx * dtype.itemsize), dtype).astype(float)
                    places = np.full(n * nx, z), np.repeat(np.arange(y, y + n), nx), np.tile(np.arange(nx), n)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, places), pa.array(v)], ["z", "y", "x", "v"])


@dataclass
class Written(WriterCommitMessage):
    voxels: int


class VtiWriter(DataSourceArrowWriter):
    """One array of cell data in a VTI file, each task's voxels written at their place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = str(_local(options["path"]))
        self.shape = tuple(int(v) for v in options.get("shape", "").split(",")) if options.get("shape") else ()
        self.kind = options.get("type", "Float32")
        if len(self.shape) != 3 or self.kind not in VTK_TYPES:
            raise ScanError("raw", "a shape z,y,x and a type of VTK are needed")
        if os.path.exists(self.path) and not overwrite:
            raise ScanError("exists", self.path)
        nz, ny, nx = self.shape
        spacing, origin = options.get("spacing", "1 1 1"), options.get("origin", "0 0 0")
        head = (
            f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n  <ImageData WholeExtent="0 {nx} 0 {ny} 0 {nz}" Origin="{origin}" Spacing="{spacing}">\n'
            f'    <Piece Extent="0 {nx} 0 {ny} 0 {nz}">\n      <PointData/>\n      <CellData>\n        <DataArray type="{self.kind}" Name="{options.get("name", "v")}" format="appended" offset="0"/>\n'
            f'      </CellData>\n    </Piece>\n  </ImageData>\n  <AppendedData encoding="raw">\n_'
        ).encode()
        size = nz * ny * nx * np.dtype(VTK_TYPES[self.kind]).itemsize
        self.head, self.tail = head + size.to_bytes(8, "little"), b"\n  </AppendedData>\n</VTKFile>\n"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.size, self.temporary = size, f"{self.path}.{uuid.uuid4().hex}.tmp"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        _, ny, nx = self.shape
        dtype, total = np.dtype("<" + VTK_TYPES[self.kind]), 0
        limits = np.iinfo(dtype) if dtype.kind in "iu" else None
        file = os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                z, y, x, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "y", "x", "v"))
                if len(z) and not all(0 <= a.min() and a.max() < n for a, n in zip((z, y, x), self.shape, strict=True)):
                    raise ScanError("outside", f"a voxel lies outside {self.shape}")
                at = (z * ny + y) * nx + x
                order = np.argsort(at, kind="stable")
                at, v = at[order], v[order]
                values = (np.clip(np.rint(v), limits.min, limits.max) if limits else v).astype(dtype)
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        os.pwrite(file, values[run].tobytes(), len(self.head) + int(at[run[0]]) * dtype.itemsize)
                total += len(at)
        finally:
            os.close(file)
        return Written(total)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        file = os.open(self.temporary, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            os.pwrite(file, self.head, 0)
            os.pwrite(file, self.tail, len(self.head) + self.size)
            os.fsync(file)
        finally:
            os.close(file)
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scan"

    def schema(self) -> str:
        return "z long, y long, x long, v double"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        scan = describe(o["path"], o.get("shape"), o.get("dtype"), int(o.get("offset", 0)), o.get("array"))
        return ScanReader(scan, int(o.get("slab", SLAB)), int(o.get("first", 0)), int(o["last"]) if "last" in o else None)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return VtiWriter(dict(self.options), overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ScanSource)
    return spark


def read_scan(spark: SparkSession, path: str, **options) -> tuple[DataFrame, Scan]:
    """(rows (z, y, x, v), scan) of a VTI, NumPy, MetaImage or raw file; options as ``describe`` takes them, ``slab``, ``first`` and ``last``."""
    scan = describe(path, options.get("shape"), options.get("dtype"), int(options.get("offset", 0)), options.get("array"))
    return _registered(spark).read.format("scan").options(**{k: str(v) for k, v in options.items()}).load(path), scan


def write_vti(rows: DataFrame, path: str, shape: tuple[int, int, int], kind: str = "Float32", spacing: float = 1.0, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), overwrite: bool = False) -> None:
    """Voxels (z, y, x, v) as one array of cell data. Whole numbers are rounded and kept within their type's limits."""
    _registered(rows.sparkSession)
    ready = rows.selectExpr("cast(z as long) z", "cast(y as long) y", "cast(x as long) x", "cast(v as double) v").repartitionByRange("z").sortWithinPartitions("z", "y", "x")
    options = {"shape": ",".join(map(str, shape)), "type": kind, "spacing": " ".join([f"{spacing!r}"] * 3), "origin": " ".join(repr(float(v)) for v in origin)}
    ready.write.format("scan").options(**options).mode("overwrite" if overwrite else "append").save(path)
