"""Reading tables and keeping intermediate tables where every executor sees them."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Local folders of this process that go when it ends: only those made where the cluster names no shared folder.
_OWN: list[str] = []


@atexit.register
def _clear() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one in the warehouse where that is unset, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir") + "/_stage").rstrip("/")


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``, where tables stay until the cluster clears
    it; the warehouse where that is unset, as in tests. ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.checkpoint.dir", None) and urlparse(path).scheme in ("", "file"):
        _OWN.append(urlparse(path).path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
