"""Rasters as tables of cells (scene, r, c, values)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import table


def cells_from_vectors(vectors: DataFrame, row: str = "vec_id", values: str = "embedding", scale: float = 1000.0) -> DataFrame:
    """One cell per vector element, as integer heights."""
    at = vectors.select(F.col(row).cast("long").alias("r"), F.posexplode(values).alias("c", "v"))
    return at.select(F.lit(0).cast("long").alias("scene"), "r", F.col("c").cast("long").alias("c"), F.round(F.col("v").cast("double") * scale).cast("long").alias("z"))


def grid(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """The analysis grid of the driver's tables; ``rows`` bounds it to its first rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cells_from_vectors(vectors if rows is None else vectors.where(F.col("vec_id") < rows))


def hill_and_valley(spark: SparkSession, n: int, cell: float = 1.0) -> DataFrame:
    """An analytic terrain: a hill, a valley with a river bed, and a tilt."""
    at = spark.range(n * n).select(F.lit(0).cast("long").alias("scene"), F.expr(f"id div {n}").alias("r"), F.expr(f"id % {n}").alias("c"))
    x, y = F.col("c") / F.lit(float(n)), F.col("r") / F.lit(float(n))
    hill = 40.0 * F.exp(-((x - 0.3) ** 2 + (y - 0.3) ** 2) / 0.02)
    valley = 15.0 * F.exp(-((x - 0.5 - 0.1 * F.sin(2 * math.pi * y)) ** 2) / 0.002)
    return at.select("scene", "r", "c", (hill - valley + 20.0 * y * cell).alias("z"))
