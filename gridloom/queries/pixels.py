"""Projections and predicates over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terrain as rules
from ..operators.neighbours import slope_degrees
from ..plans.terrain import cover_shares
from ..sources.grid import grid
from ..storage import table
from . import GRID


def grid_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = slope_degrees(grid(spark, sf_dir), "z", 400.0)
    cover = rules.land_cover(F.col("z") > 120, F.col("z") < -180, F.col("z") % 2 == 0, F.col("slope"))
    return cover_shares(cells.select(cover.alias("cover")))


def _coloured(cells: DataFrame) -> DataFrame:
    return cells.select("r", *[(F.abs("z") * k % 256).alias(n) for n, k in (("red", 7), ("green", 13), ("blue", 29))])


def exg_and_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = _coloured(grid(spark, sf_dir))
    exg, wet = rules.excess_green(*[F.col(c) for c in ("red", "green", "blue")]), rules.water_colour(*[F.col(c) for c in ("red", "green", "blue")])
    return rgb.groupBy("r").agg(F.count_if(exg > 0.06).alias("vegetated"), F.count_if(wet).alias("watery"), F.max(exg).alias("greenest"))


def confidence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    found = rules.confidence(F.abs(z) % 70 / 10.0, F.abs(z) / 10.0, z % 11 == 0, z < -180)
    return grid(spark, sf_dir).groupBy(found.alias("confidence")).agg(F.count("*").alias("n"))


def landslide_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    most = cells.agg(F.max(F.log1p(F.abs("z").cast("double"))).alias("most"))  # one row
    score = rules.landslide_score((F.abs("z") % 60).cast("double"), F.log1p(F.abs("z").cast("double")) / F.col("most"), F.abs("z") % 10 / 10.0)
    scored = cells.crossJoin(F.broadcast(most)).withColumn("score", score)
    return scored.groupBy("r").agg(F.count_if(F.col("score") >= 0.5).alias("sources"), F.round(F.sum("score"), 6).alias("score"))


def cost_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    depth = F.greatest(F.lit(0.0), F.least(F.lit(3.0), (-150 - z) / 20.0))
    mult = F.when((z > 120) & (z < 200), 4.0).otherwise(F.when(z < -200, 15.0).when(z % 7 == 0, 1.3).otherwise(1.0) + F.when(z < -150, 1.0 + depth).otherwise(0.0))
    return grid(spark, sf_dir).groupBy(F.round(mult, 6).alias("mult")).agg(F.count("*").alias("n"))


def population_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    people = rules.population(F.col("o_orderstatus") == "F", F.floor("o_totalprice") % 90 / 2.0, 225.0)
    return orders.groupBy("c_nationkey").agg(F.sum(people).alias("people"))


QUERIES = {f.__name__: f for f in (grid_from_embeddings, exg_and_masks, confidence_case, landslide_score, cost_multiplier, population_estimate)}

SLOPE = """
    d AS (SELECT r, c, z,
        (coalesce(lead(z) OVER cr, z) - coalesce(lag(z) OVER cr, z)) / (CASE WHEN lead(z) OVER cr IS NULL OR lag(z) OVER cr IS NULL THEN 1.0 ELSE 2.0 END * CAST(400 AS DOUBLE)) AS gr,
        (coalesce(lead(z) OVER cc, z) - coalesce(lag(z) OVER cc, z)) / (CASE WHEN lead(z) OVER cc IS NULL OR lag(z) OVER cc IS NULL THEN 1.0 ELSE 2.0 END * CAST(400 AS DOUBLE)) AS gc
        FROM g WINDOW cr AS (PARTITION BY c ORDER BY r), cc AS (PARTITION BY r ORDER BY c)),
    p AS (SELECT r, c, z, degrees(atan(sqrt(gr * gr + gc * gc))) AS slope FROM d)"""

ORACLES = {
    "grid_from_embeddings": f"""WITH {GRID}, {SLOPE},
        k AS (SELECT CASE WHEN z < -180 THEN 5 WHEN z > 120 THEN 4 WHEN slope >= 15 AND z % 2 = 0 THEN 2 WHEN slope >= 15 THEN 1 WHEN z % 2 = 0 THEN 3 ELSE 0 END AS cover FROM p),
        n AS (SELECT cover, count(*) AS n FROM k GROUP BY cover)
        SELECT CAST(i AS INTEGER) AS cover, coalesce(n, 0) AS n, (SELECT count(*) FROM k) AS total FROM range(6) t(i) LEFT JOIN n ON n.cover = i""",
    "exg_and_masks": f"""WITH {GRID}, k AS (SELECT r, CAST(abs(z) * 7 % 256 AS DOUBLE) AS a, CAST(abs(z) * 13 % 256 AS DOUBLE) AS b, CAST(abs(z) * 29 % 256 AS DOUBLE) AS d FROM g),
        x AS (SELECT r, (2 * b - a - d) / (a + b + d + 1) AS exg, a / 255 AS p, b / 255 AS q, d / 255 AS w FROM k),
        y AS (SELECT *, greatest(p, q, w) AS top, greatest(p, q, w) - least(p, q, w) AS span FROM x),
        h AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = p THEN CASE WHEN q < w THEN 60 * (q - w) / span + 360 ELSE 60 * (q - w) / span END
                             WHEN top = q THEN 60 * (w - p) / span + 120 ELSE 60 * (p - q) / span + 240 END AS hue FROM y)
        SELECT r, count(*) FILTER (exg > CAST(0.06 AS DOUBLE)) AS vegetated,
               count(*) FILTER (hue > 185 AND hue < 250 AND CASE WHEN top = 0 THEN 0 ELSE span / top END > CAST(0.25 AS DOUBLE) AND top > CAST(0.08 AS DOUBLE) AND top < CAST(0.8 AS DOUBLE)) AS watery,
               max(exg) AS greenest FROM h GROUP BY r""",
    "confidence_case": f"""WITH {GRID}, k AS (SELECT z, abs(z) % 70 / CAST(10 AS DOUBLE) AS sigma, abs(z) / CAST(10 AS DOUBLE) AS h FROM g),
        f AS (SELECT z, CASE WHEN sigma < greatest(2.0, CAST(0.2 AS DOUBLE) * h) THEN 2 WHEN sigma < greatest(5.0, CAST(0.5 AS DOUBLE) * h) THEN 1 ELSE 0 END AS f FROM k)
        SELECT CASE WHEN z < -180 THEN 0 WHEN z % 11 = 0 THEN least(f, 1) ELSE f END AS confidence, count(*) AS n FROM f GROUP BY 1""",
    "landslide_score": f"""WITH {GRID}, k AS (SELECT r, CAST(abs(z) % 60 AS DOUBLE) AS slope, ln(1 + CAST(abs(z) AS DOUBLE)) / max(ln(1 + CAST(abs(z) AS DOUBLE))) OVER () AS acc, abs(z) % 10 / CAST(10 AS DOUBLE) AS veg FROM g),
        s AS (SELECT r, CAST(0.6 AS DOUBLE) * greatest(0.0, least(1.0, (slope - 15) / 25)) + CAST(0.25 AS DOUBLE) * CASE WHEN slope > 10 THEN acc ELSE 0 END + CAST(0.15 AS DOUBLE) * (1 - veg) AS score FROM k)
        SELECT r, count(*) FILTER (score >= 0.5) AS sources, round(sum(score), 6) AS score FROM s GROUP BY r""",
    "cost_multiplier": f"""WITH {GRID}
        SELECT round(CASE WHEN z > 120 AND z < 200 THEN 4.0 ELSE CAST(CASE WHEN z < -200 THEN 15.0 WHEN z % 7 = 0 THEN 1.3 ELSE 1.0 END AS DOUBLE)
                 + CASE WHEN z < -150 THEN 1.0 + greatest(0.0, least(3.0, (-150 - z) / CAST(20 AS DOUBLE))) ELSE 0 END END, 6) AS mult, count(*) AS n FROM g GROUP BY 1""",
    "population_estimate": """SELECT c_nationkey, sum(CASE WHEN o_orderstatus = 'F' THEN 225.0 * greatest(1, round_even(CAST(floor(o_totalprice) % 90 / 2.0 / 3.0 AS DOUBLE), 0)) / 15.0 ELSE 0 END) AS people
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""",
}
