"""Tables, and written intermediate results that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, as in tests, a folder that goes with the process."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridloom-grid-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: ends its lineage."""
    path = f"{_shared(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
