"""Masks, ground, gaps, shadows and profiles on the way from an image to heights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..sources.grid import grid
from ..storage import table
from . import GRID
from .surroundings import _H, _box_sums, _mirror, _near

W, AZIMUTH, STEPS = 64, 135.0, 20


def _height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def vegetation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).select("scene", "r", "c", *[(F.abs("z") * k % 256).alias(n) for n, k in (("red", 1), ("green", 7), ("blue", 3))])
    return cal.vegetation(cells, _height(spark, sf_dir), W).where("veg").select("r", "c")


def elevated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of raised cells, with single cells of water in them."""
    block = (F.col("r") % 9 < 6) & (F.col("c") % 11 < 7)
    cells = grid(spark, sf_dir).select("scene", "r", "c", (F.abs("z") / 400.0 + F.when(block, 2.0).otherwise(0.0)).alias("rel"), (F.pmod("z", F.lit(13)) == 0).alias("water"))
    return cal.elevated(cells, "rel", "water").where("high").select("r", "c")


def ground_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.ground_surface(grid(spark, sf_dir), "z", 5, _height(spark, sf_dir), W).select("r", "c", F.round("z", 5).alias("z"))


def bare_earth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("building", F.col("z") > 120)
    return cal.bare_earth(cells, "z", "building", _height(spark, sf_dir), W).select("r", "c", F.round("z", 5).alias("z"))


def nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("z", F.when(F.pmod("z", F.lit(11)) != 0, F.col("z")))
    return cal.filled_gaps(cells, "z", W).select("r", "c", "z")


def _town(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High cells as buildings, one in each block of eight by eight cells, and most others in shadow."""
    block = F.expr("r div 8 * 8 + c div 8")
    return grid(spark, sf_dir).select(
        "scene", "r", "c", F.when(F.col("z") > 120, block).alias("label"), ((F.abs("z") % 4 < 3) & (F.col("z") <= 120)).alias("shadow"), (F.abs("z") / 400.0).alias("rel")
    )


def shadow_lengths_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.shadow_walk(_town(spark, sf_dir), "label", "shadow", AZIMUTH, STEPS).select("r", "c", "label", "length", "valid")


def shadow_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cal.shadow_anchors(_town(spark, sf_dir), "label", "shadow", "rel", 1.0, 40.0, AZIMUTH, float(STEPS))
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("row", "col", "rel", "h", "spread")], "w")


def merged_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    detected = cells.where("z > 100").select("scene", "r", "c", F.expr("r div 4 + 1").alias("label"))
    mapped = cells.where("z > 60 AND c < 20").select("scene", "r", "c", F.expr("r div 16 + 1").alias("label"))
    return cal.merged_buildings(detected, mapped).select("r", "c", "label")


def dem_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as control points, by return flag."""
    points = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("dem"), (F.col("l_linenumber") % 2 == 1).alias("ground"))
    found = cal.dem_bias(points, ["l_returnflag"], "l_quantity", "dem", "ground")
    return found.withColumn("bias", F.round("bias", 6))


def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments, one of which leaves the grid."""
    ends = spark.createDataFrame([(0, 1, 0.0625, 0.125, 0.875, 0.9375), (0, 2, -0.25, 0.5, 1.25, 0.25)], "scene long, segment int, u0 double, v0 double, u1 double, v1 double")
    return cal.profile(grid(spark, sf_dir), ["z"], ends, _height(spark, sf_dir), W).drop("scene")


QUERIES = {
    f.__name__: f
    for f in (
        vegetation_mask, elevated_cells, ground_surface, bare_earth, nearest_fill, shadow_lengths_ray, shadow_anchors, merged_buildings, dem_bias, profile_sample,
    )
}


def _blur(sigma: float, source: str, name: str, values: str = "z") -> str:
    """Two filters, along a row and along a column."""
    half = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    kernel = ", ".join(f"({k}, CAST('{w / sum(raw)!r}' AS DOUBLE))" for k, w in zip(range(-half, half + 1), raw, strict=True))
    total = lambda alias: ", ".join(f"sum({alias}.{v} * w) AS {v}" for v in values.split())
    return f"""{name}k(i, w) AS (VALUES {kernel}),
        {name}1 AS MATERIALIZED (SELECT a.r, a.c, {total("b")} FROM {source} a, {name}k, {source} b WHERE b.r = a.r AND b.c = {_mirror("a.c + i", "64")} GROUP BY a.r, a.c),
        {name} AS MATERIALIZED (SELECT a.r, a.c, {total("b")} FROM {name}1 a, h, {name}k, {name}1 b WHERE b.c = a.c AND b.r = {_mirror("a.r + i", "h")} GROUP BY a.r, a.c)"""


_DR, _DC = math.cos(math.radians(AZIMUTH)), -math.sin(math.radians(AZIMUTH))
_AT = f"CAST(round_even({{a}}.r + {{t}} * CAST('{_DR!r}' AS DOUBLE), 0) AS BIGINT) AS nr, CAST(round_even({{a}}.c + {{t}} * CAST('{_DC!r}' AS DOUBLE), 0) AS BIGINT) AS nc"
_WALK = f"""t AS MATERIALIZED (SELECT r, c, CASE WHEN z > 120 THEN r // 8 * 8 + c // 8 END AS label, abs(z) % 4 < 3 AND z <= 120 AS shadow, abs(z) / CAST(400 AS DOUBLE) AS rel FROM g),
    e0 AS (SELECT r, c, label, {_AT.format(a="t", t=1)} FROM t WHERE label IS NOT NULL),
    e AS (SELECT e0.r, e0.c, e0.label FROM e0 JOIN t ON t.r = nr AND t.c = nc WHERE t.shadow AND t.label IS DISTINCT FROM e0.label),
    y AS (SELECT e.r, e.c, e.label, i, {_AT.format(a="e", t="i")} FROM e, range(1, {STEPS + 1}) u(i)),
    q AS (SELECT y.r, y.c, y.label, i, t.r IS NOT NULL AND t.label IS NULL AS clean FROM y LEFT JOIN t ON t.r = nr AND t.c = nc WHERE NOT coalesce(t.shadow, false)),
    s AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY i) = 1),
    walk AS (SELECT e.r, e.c, e.label, coalesce(i, {STEPS + 1}) - 1 AS length, coalesce(clean, false) AS valid FROM e LEFT JOIN s USING (r, c))"""

ORACLES = {
    "vegetation_mask": f"""WITH {GRID}, {_H}, p AS MATERIALIZED (SELECT r, c, abs(z) % 256 AS red, abs(z) * 7 % 256 AS green, abs(z) * 3 % 256 AS blue FROM g),
        y AS MATERIALIZED (SELECT r, c, (red + green + blue) / CAST(3 AS DOUBLE) AS m, m * m AS q FROM p), {_box_sums("y", "m q", 2, "x")}
        SELECT r, c FROM p JOIN x USING (r, c) WHERE (2 * green - red - blue) / CAST(red + green + blue + 1 AS DOUBLE) > 0.06 AND sqrt(greatest(x.q / 25 - x.m / 25 * x.m / 25, 0)) > 5""",
    "elevated_cells": f"""WITH {GRID}, v AS MATERIALIZED (SELECT r, c, z, abs(z) / CAST(400 AS DOUBLE) + CASE WHEN r % 9 < 6 AND c % 11 < 7 THEN 2 ELSE 0 END AS rel FROM g),
        l AS (SELECT greatest(0.02, 0.2 * quantile_cont(rel, 0.99)) AS lim FROM v), m AS (SELECT r, c, CAST(rel > lim AND z % 13 <> 0 AS INTEGER) AS z FROM v, l),
        {_near(1, 1, "min", "m", "a")}, {_near(1, 1, "max", "a", "b")} SELECT r, c FROM b WHERE z = 1""",
    "ground_surface": f"WITH {GRID}, {_H}, {_blur(1.0, 'g', 'x')}, {_near(2, 2, 'min', 'x', 'a')}, {_near(2, 2, 'max', 'a', 'b')}, {_blur(5 / 3, 'b', 'y')} SELECT r, c, round(z, 5) AS z FROM y",
    "bare_earth": f"""WITH {GRID}, {_H}, o AS MATERIALIZED (SELECT r, c, CASE WHEN z > 120 THEN 0 ELSE z END AS num, CAST(z <= 120 AS INTEGER) AS den FROM g), {_blur(2.0, "o", "x", "num den")}
        SELECT r, c, round(CASE WHEN z > 120 THEN num / den ELSE z END, 5) AS z FROM g JOIN x USING (r, c)""",
    "nearest_fill": f"""WITH {GRID}, f AS (SELECT a.r, a.c, arg_min(b.z, ((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 1000000000 + b.r * 64 + b.c) AS z
            FROM g a JOIN g b ON b.r BETWEEN a.r - 12 AND a.r + 12 AND b.z % 11 <> 0 WHERE a.z % 11 = 0 GROUP BY a.r, a.c)
        SELECT r, c, z FROM f UNION ALL SELECT r, c, z FROM g WHERE z % 11 <> 0""",
    "shadow_lengths_ray": f"WITH {GRID}, {_WALK} SELECT r, c, label, length, valid FROM walk",
    "shadow_anchors": f"""WITH {GRID}, {_WALK}, k AS (SELECT label, count(*) AS n, quantile_cont(CAST(length AS DOUBLE), 0.25) AS a, quantile_cont(CAST(length AS DOUBLE), 0.75) AS b FROM walk WHERE valid GROUP BY label HAVING count(*) >= 3),
        j AS (SELECT label, avg(r) AS row, avg(c) AS col, quantile_cont(rel, 0.75) AS rel FROM t WHERE label IS NOT NULL GROUP BY label)
        SELECT label, round(row, 6) AS row, round(col, 6) AS col, round(rel, 6) AS rel, round((b + 0.5) * tan(radians(40.0)), 6) AS h, round(greatest(b - a, 1) * tan(radians(40.0)), 6) AS spread, CAST(least(n, 20) AS DOUBLE) AS w
        FROM k JOIN j USING (label) WHERE (b + 0.5) * tan(radians(40.0)) >= 2 AND rel > 0.005""",
    "merged_buildings": f"""WITH {GRID}, m AS (SELECT r, c, r // 16 + 1 AS label FROM g WHERE z > 60 AND c < 20), d AS (SELECT r, c, r // 4 + 1 + (SELECT max(label) FROM m) AS label FROM g WHERE z > 100)
        SELECT r, c, label FROM m UNION ALL SELECT r, c, label FROM d ANTI JOIN m USING (r, c)""",
    "dem_bias": "SELECT l_returnflag, round(median(l_quantity - l_discount * 100), 6) AS bias, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_returnflag",
    "profile_sample": f"""WITH {GRID}, {_H}, s(segment, u0, v0, u1, v1) AS (VALUES (1, CAST('0.0625' AS DOUBLE), CAST('0.125' AS DOUBLE), CAST('0.875' AS DOUBLE), CAST('0.9375' AS DOUBLE)), (2, CAST('-0.25' AS DOUBLE), CAST('0.5' AS DOUBLE), CAST('1.25' AS DOUBLE), CAST('0.25' AS DOUBLE))),
        p AS (SELECT segment, CAST(k AS INTEGER) AS k, least(greatest(CAST(trunc((v0 + k * ((v1 - v0) / 199)) * h) AS BIGINT), 0), h - 1) AS r, least(greatest(CAST(trunc((u0 + k * ((u1 - u0) / 199)) * 64) AS BIGINT), 0), 63) AS c,
              round(k * (sqrt(pow((u1 - u0) * 64, 2) + pow((v1 - v0) * h, 2)) / 199), 2) AS distance FROM s, h, range(200) t(k))
        SELECT segment, k, distance, z FROM p JOIN g USING (r, c)""",
}
