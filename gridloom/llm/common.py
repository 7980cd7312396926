"""Helpers shared by the operators: shared folders, Arrow text buffers and slices."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_shipped: set[str] = set()


def _temporary() -> str:
    """A folder of the driver's that goes when its process ends."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to the executors, which need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent.parent
        with zipfile.ZipFile(to := f"{_temporary()}/{package.name}-{len(_shipped)}.zip", "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(to)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); where that is unset, as in
    tests on one machine, in a temporary folder that goes when the process ends.  A cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + _temporary()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], label: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in ``order`` with ``row``, its place from 0, and for each column of ``sums`` the total of all rows before.

    Range partitions are sorted and written once.  One total per partition gives the partitions' offsets by a prefix
    sum, and these join back: a row per partition, far below any table's size.  ``order`` should tell all rows apart,
    or rows that it does not tell apart stay in one partition.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), label)
    part, before = F.shiftright("place", 33), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(part.alias("part")).agg(F.count("*").alias("row"), *[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_offset") for c in ("row", *sums)])
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumns({"part": part} | ({"row": F.col("place").bitwiseAND((1 << 33) - 1)}))
    running = running.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}) if sums else running
    joined = running.join(F.broadcast(offsets), "part")
    whole = {"row": F.col("row") + F.col("row_offset")} | {f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_offset") for c in sums}
    return joined.withColumns(whole).drop("part", "place", *[f"{c}_offset" for c in ("row", *sums)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """crc32 of a value as text, modulo ``n``; null stays null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
