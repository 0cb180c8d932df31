"""Versioned snapshots of several tables: written aside, checked, and switched to by one small file.

A snapshot is a folder ``v-<number>-<id>`` of Parquet tables and a manifest: schema version, case, and for each table its
schema, rows and a checksum that does not depend on the rows' order. The folder is complete before the file CURRENT, which
names it, is replaced; a reader sees the old snapshot or the new one. The one before stays; older ones go. Files of the
switch are written through Hadoop's file system, so any path that Spark writes will do.

A snapshot of another schema version or case, or whose tables are not what the manifest says, is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the layout; others are refused.
SCHEMA = 1
KEPT = 2


class SnapshotError(ValueError):
    """A snapshot that cannot be used; ``code`` is stable."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


class _Files:
    """Small files by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = root.rstrip("/")

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written aside and renamed over the old one."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(aside, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.fs.makeQualified(self.at(aside)), self.fs.makeQualified(self.at(name)), options)

    def folders(self) -> list[str]:
        if not self.fs.exists(self.path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)) if s.isDirectory())

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _facts(df: DataFrame) -> dict:
    """Rows and a checksum of them, which is a sum and so free of their order."""
    of = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]) if df.columns else F.lit(0).cast("long")
    r = df.agg(F.count("*").alias("n"), F.sum(of.cast("decimal(38,0)")).alias("s")).first()
    return {"rows": r["n"], "sum": str(r["s"] or 0)}


def save_snapshot(tables: dict[str, DataFrame], root: str, case: str, iteration: int = 0, facts: dict | None = None) -> str:
    """Writes the tables and then switches to them; the snapshot's name. ``facts`` are small values kept beside them."""
    if not tables:
        raise SnapshotError("empty", "a snapshot has tables")
    spark = next(iter(tables.values())).sparkSession
    files = _Files(spark, root)
    name = f"v-{iteration:012d}-{uuid.uuid4().hex}"
    manifest: dict = {"schema": SCHEMA, "case": case, "iteration": iteration, "facts": facts or {}, "tables": {}}
    for t, df in tables.items():
        path = f"{files.root}/{name}/{t}"
        df.write.parquet(path)
        manifest["tables"][t] = {"schema": df.schema.jsonValue(), **_facts(spark.read.schema(df.schema).parquet(path))}
    files.write(f"{name}/manifest.json", json.dumps(manifest))
    last = files.read("CURRENT")
    files.replace("CURRENT", name)
    stay = {name, *([last] if last and KEPT > 1 else [])}
    for old in files.folders():
        if old.startswith("v-") and old not in stay:
            files.remove(old)
    return name


def load_snapshot(spark: SparkSession, root: str, case: str, name: str | None = None, check: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) of the current snapshot, or of ``name``. With ``check`` every table is counted and summed first."""
    from pyspark.sql.types import StructType

    files = _Files(spark, root)
    name = name or files.read("CURRENT")
    text = files.read(f"{name}/manifest.json") if name else None
    if text is None:
        raise SnapshotError("missing", f"no snapshot in {root}")
    manifest = json.loads(text)
    if manifest.get("schema") != SCHEMA:
        raise SnapshotError("schema", f"version {manifest.get('schema')} is not {SCHEMA}")
    if manifest["case"] != case:
        raise SnapshotError("case", f"the snapshot is of {manifest['case']!r}, not of {case!r}")
    tables = {}
    for t, facts in manifest["tables"].items():
        df = spark.read.schema(StructType.fromJson(facts["schema"])).parquet(f"{files.root}/{name}/{t}")
        if check and (found := _facts(df)) != {k: facts[k] for k in ("rows", "sum")}:
            raise SnapshotError("damaged", f"{t} has {found['rows']} rows that are not what was written")
        tables[t] = df
    return tables, manifest


def due(iteration: int, last: int | None, interval: int, ended: bool = False) -> bool:
    """Whether a run saves now: at an interval's multiple that it passed since the last time, and at its end; never twice."""
    if iteration == 0 or iteration == last:
        return False
    return ended or (iteration >= interval if last is None else iteration // interval > last // interval)
