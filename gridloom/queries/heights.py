"""Calibration of many scenes in one plan: scales by precedence, fused heights, modes with and without metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as st
from ..plans import heights
from ..sources.grid import grid
from ..storage import settle, table
from . import GRID


def sun_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as scenes, of which the user, the tags or the time of day tell the sun."""
    k = F.col("s_suppkey")
    some = lambda n, v: F.when(k % n == 0, v).cast("double")
    scenes = table(spark, sf_dir, "supplier").select(
        k.alias("scene"), some(3, 20.0 + k % 50).alias("user_sun_elevation"), some(6, k % 360).alias("user_sun_azimuth"), some(2, 10.0 + k % 70).alias("tag_sun_elevation"),
        some(4, k * 7 % 360).alias("tag_sun_azimuth"), some(5, k % 30).alias("user_off_nadir"), some(2, k % 25).alias("tag_off_nadir"), some(7, k % 360).alias("user_view_azimuth"),
        some(1, k % 180).alias("tag_view_azimuth"), F.when(k % 5 != 0, F.timestamp_seconds(F.lit(1_700_000_000) + k * 3600)).alias("acquired"), some(1, k % 180).alias("lon"), some(1, k % 60).alias("lat"),
    )
    found = heights.resolved(scenes)
    told = F.col("sun_source") != "computed from acquisition time"
    return found.select("scene", "sun_source", F.when(told, F.col("sun_elevation")).alias("sun_elevation"), F.when(told, F.col("sun_azimuth")).alias("sun_azimuth"), "off_nadir", "view_azimuth")


def scale_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as scenes: some have anchors, some a surface model that agrees, some a prior, and some nothing."""
    s, n, rel = F.col("s_suppkey"), F.col("s_nationkey"), (F.col("s_suppkey") % 40 + 1) / F.lit(100.0)
    found = table(spark, sf_dir, "supplier").where(n % 3 == 0)
    anchors = found.select(
        n.alias("scene"), F.when(s % 2 == 0, "shadow").otherwise("gcp").alias("source"), rel.alias("rel"), (rel * (10 + n + s % 5 + F.when(s % 11 == 0, 90).otherwise(0))).alias("h"), (s % 7 + 1).cast("double").alias("w")
    )
    c = F.col("c_custkey")
    detail = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), (c % 17 - 8).cast("double").alias("rel"), ((c % 17 - 8) * F.when(F.col("c_nationkey") % 2 == 0, 2).otherwise(-2) + c % 5).cast("double").alias("dem"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scene"), F.when(F.col("n_nationkey") % 5 == 1, 30.0).alias("prior_m"))
    out = heights.scaled(nations, st.inlier_anchors(anchors, ["scene"]), st.band_scale(detail, ["scene"], "rel", "dem"), nations.select("scene", F.lit(0.5).alias("top")))
    return out.withColumn("scale", F.round("scale", 6))


def fused_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scenes, one with a scale and anchors and one without."""
    z = F.col("z")
    cells = grid(spark, sf_dir).select(
        F.expr("c div 32").alias("scene"), "r", (F.col("c") % 32).alias("c"), (F.abs(z) / 400.0).alias("above"), (F.abs(z) % 50 / 1000.0).alias("unc"), (z > 120).alias("building"),
        z.between(60, 120).alias("tree"), F.when(z > 120, F.expr("r div 8 * 4 + c % 32 div 8")).alias("label"),
    )
    label = F.col("label")
    body = cells.where("building AND scene = 0").groupBy("scene", "label").agg(F.avg("above").alias("rel"))
    anchors = body.select(
        "scene", F.when(label % 2 == 0, "shadow").otherwise("osm").alias("source"), "label", "rel", (10.0 + label % 7 * 3).alias("h"), F.when(label % 5 != 0, (label % 3).cast("double")).alias("spread"), F.lit(1.0).alias("w")
    ).where(label % 4 != 3)
    scales = spark.createDataFrame([(0, 30.0), (1, None)], "scene long, scale double")
    out = heights.fused(cells, scales, settle(anchors, "anchors"))
    return out.select("scene", "r", "c", F.round("ndsm", 6).alias("ndsm"), F.round("doubt", 6).alias("doubt"))


def height_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scenes: ground and heights in metres, only heights, only ground, neither."""
    z, scene = F.col("z"), F.expr("c div 16")
    cells = grid(spark, sf_dir).select(
        scene.alias("scene"), "r", (F.col("c") % 16).alias("c"), (F.abs(z) / 400.0).alias("rel"), (F.abs(z) % 100 / 100.0).alias("unc"), (F.abs(z) / 20.0).alias("ndsm"), (F.abs(z) % 60 / 10.0).alias("doubt"),
        (F.pmod(z, F.lit(13)) == 0).alias("shadow"), (F.pmod(z, F.lit(17)) == 0).alias("water"), F.when(scene % 2 == 0, F.col("r") * 0.5).alias("dem"),
    )
    scales = spark.createDataFrame([(0, "m"), (1, "m"), (2, "relative"), (3, "relative")], "scene long, unit string")
    out = heights.assembled(cells, scales, "dem", 4.0, 1, 1, surface=False)
    return out.select("scene", "r", "c", "mode", *[F.round(x, 6).alias(x) for x in ("dtm", "dsm", "sigma")], "confidence")


QUERIES = {f.__name__: f for f in (sun_precedence, scale_precedence, fused_heights, height_modes)}

_d = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
_some = lambda n, v: f"CAST(CASE WHEN s_suppkey % {n} = 0 THEN {v} END AS DOUBLE)"


def _wmedian(source: str, name: str) -> str:
    return f"""{name} AS (SELECT scene, min(k) AS {name} FROM (SELECT scene, k, sum(w) OVER (PARTITION BY scene ORDER BY k) AS cw, sum(w) OVER (PARTITION BY scene) AS tw
        FROM (SELECT scene, k, sum(w) AS w FROM {source} GROUP BY scene, k)) WHERE cw >= tw / 2 GROUP BY scene)"""


ORACLES = {
    "sun_precedence": f"""
        WITH a AS (SELECT s_suppkey AS scene, {_some(3, "20 + s_suppkey % 50")} AS ue, {_some(6, "s_suppkey % 360")} AS ua, {_some(2, "10 + s_suppkey % 70")} AS te, {_some(4, "s_suppkey * 7 % 360")} AS ta,
                   coalesce({_some(5, "s_suppkey % 30")}, {_some(2, "s_suppkey % 25")}) AS off_nadir, coalesce({_some(7, "s_suppkey % 360")}, CAST(s_suppkey % 180 AS DOUBLE)) AS view_azimuth FROM supplier)
        SELECT scene, CASE WHEN ue + ua IS NOT NULL THEN 'entered by user' WHEN te + ta IS NOT NULL THEN 'image metadata' WHEN scene % 5 <> 0 THEN 'computed from acquisition time' END AS sun_source,
               CASE WHEN ue + ua IS NOT NULL THEN ue WHEN ta IS NOT NULL THEN te END AS sun_elevation, CASE WHEN ue + ua IS NOT NULL THEN ua WHEN te IS NOT NULL THEN ta END AS sun_azimuth, off_nadir, view_azimuth FROM a""",
    "scale_precedence": f"""
        WITH u AS (SELECT s_nationkey AS scene, CASE WHEN s_suppkey % 2 = 0 THEN 'shadow' ELSE 'gcp' END AS source, (s_suppkey % 40 + 1) / {_d(100)} AS rel,
                   (s_suppkey % 40 + 1) / {_d(100)} * (10 + s_nationkey + s_suppkey % 5 + CASE WHEN s_suppkey % 11 = 0 THEN 90 ELSE 0 END) AS h, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS w FROM supplier WHERE s_nationkey % 3 = 0),
        a AS (SELECT *, h / rel AS k, count(*) OVER (PARTITION BY scene) AS n FROM u WHERE rel > 0.005 AND h > 0), {_wmedian("a", "first")},
        m AS (SELECT scene, median(abs(k - first)) AS mad FROM a JOIN first USING (scene) GROUP BY scene),
        i AS (SELECT a.* FROM a JOIN first USING (scene) JOIN m USING (scene) WHERE abs(k - first) <= greatest(3 * {_d(st.NMAD)} * mad, 0.25 * first)), {_wmedian("i", "fit")},
        t AS (SELECT scene, count(*) AS inliers, max(n) AS anchors, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM i GROUP BY scene),
        d AS (SELECT c_nationkey AS scene, CAST(c_custkey % 17 - 8 AS DOUBLE) AS x, CAST((c_custkey % 17 - 8) * CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE -2 END + c_custkey % 5 AS DOUBLE) AS y FROM customer),
        b AS (SELECT scene, sum(x * y) / sum(x * x) AS s FROM d GROUP BY scene HAVING count(*) >= 64 AND corr(x, y) >= 0.1 AND s > 0)
        SELECT n_nationkey AS scene, round(coalesce(fit, s, CASE WHEN n_nationkey % 5 = 1 THEN 60 END), 6) AS scale,
               CASE WHEN fit IS NOT NULL THEN sources WHEN s IS NOT NULL THEN 'dem_band' WHEN n_nationkey % 5 = 1 THEN 'user prior' END AS scale_source,
               CASE WHEN fit IS NULL AND s IS NULL AND n_nationkey % 5 <> 1 THEN 'relative' ELSE 'm' END AS unit, coalesce(inliers, 0) AS inliers, coalesce(anchors, 0) AS anchors
        FROM nation LEFT JOIN fit ON fit.scene = n_nationkey LEFT JOIN t ON t.scene = n_nationkey LEFT JOIN b ON b.scene = n_nationkey""",
    "fused_heights": f"""
        WITH {GRID}, v AS (SELECT c // 32 AS scene, r, c % 32 AS c, abs(z) / {_d(400)} AS above, abs(z) % 50 / {_d(1000)} AS unc, z > 120 AS building, z BETWEEN 60 AND 120 AS tree,
                   CASE WHEN z > 120 THEN r // 8 * 4 + c % 32 // 8 END AS label FROM g),
        a AS (SELECT label, avg(above) AS rel, 10 + label % 7 * {_d(3)} AS h, CASE WHEN label % 5 <> 0 THEN CAST(label % 3 AS DOUBLE) END AS spread FROM v WHERE building AND scene = 0 AND label % 4 <> 3 GROUP BY label),
        m AS (SELECT median(h) AS med, CASE WHEN count(*) >= 8 THEN greatest(0, corr(rel, h)) ELSE 1 END AS rho FROM a),
        e AS (SELECT med, rho, sqrt(avg(pow(med + rho * (30 * rel - med) - h, 2))) AS rmse FROM a, m GROUP BY med, rho)
        SELECT scene, r, c, round(CASE WHEN scene = 1 THEN above WHEN building THEN coalesce(h, greatest(0, med + rho * (above * 30 - med))) WHEN tree THEN above * 30 ELSE 0 END, 6) AS ndsm,
               round(CASE WHEN scene = 1 THEN 2 * unc + {_d(0.02)} WHEN building THEN CASE WHEN h IS NULL THEN rmse ELSE sqrt(pow(coalesce(spread, 1), 2) + 1) END
                     WHEN tree THEN greatest(60 * unc, {_d(0.35)} * (above * 30)) ELSE {_d(0.7)} END, 6) AS doubt
        FROM v LEFT JOIN a ON a.label = v.label AND scene = 0, e""",
    "height_modes": f"""
        WITH {GRID}, v AS (SELECT c // 16 AS scene, r, c % 16 AS c, abs(z) / {_d(400)} AS rel, abs(z) % 100 / {_d(100)} AS unc, abs(z) / {_d(20)} AS ndsm, abs(z) % 60 / {_d(10)} AS doubt,
                   z % 13 = 0 AS shadow, z % 17 = 0 AS water, r * {_d(0.5)} AS dem FROM g),
        q AS (SELECT scene, quantile_cont(unc, 0.6) AS q60, quantile_cont(unc, 0.9) AS q90 FROM v GROUP BY scene),
        f AS (SELECT *, CASE WHEN scene < 2 THEN CASE WHEN doubt < greatest(2, 0.2 * ndsm) THEN 2 WHEN doubt < greatest(5, 0.5 * ndsm) THEN 1 ELSE 0 END
                             ELSE CASE WHEN unc <= q60 THEN 2 WHEN unc <= q90 THEN 1 ELSE 0 END END AS sure FROM v JOIN q USING (scene))
        SELECT scene, r, c, ['absolute', 'above_ground', 'terrain_only', 'relative'][scene + 1] AS mode, round(CASE WHEN scene % 2 = 0 THEN dem END, 6) AS dtm,
               round(CASE scene WHEN 0 THEN dem + ndsm WHEN 1 THEN ndsm WHEN 2 THEN dem ELSE rel END, 6) AS dsm, round(CASE scene WHEN 0 THEN sqrt(doubt * doubt + 25) WHEN 2 THEN 5 ELSE doubt END, 6) AS sigma,
               CAST(CASE WHEN water THEN 0 WHEN shadow THEN least(sure, 1) ELSE sure END AS INTEGER) AS confidence FROM f""",
}
