"""Scalar rules over the driver's rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, solar
from ..functions import terrain as rules
from ..storage import table


def tobler_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long").alias("slope_percent")).distinct()
    return rows.select("slope_percent", F.round(rules.tobler_speed(F.col("slope_percent") / 100.0), 9).alias("speed"))


def sun_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("user_id") % 120 - 60.0, F.col("user_id") % 360 - 180.0
    up, az = solar.sun_position(F.col("ts"), lat, lon)
    return table(spark, sf_dir, "events").select("event_id", F.round(up, 6).alias("elevation"), F.round(az, 5).alias("azimuth"))


def utm_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("c_custkey") % 3590 / 10.0 - 179.5, F.col("c_custkey") % 160 - 80.0
    east, north = geo.utm(lon, lat)
    return table(spark, sf_dir, "customer").select("c_custkey", geo.utm_epsg(lon, lat).alias("epsg"), F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    south, west = F.col("s_suppkey") % 120 - 60 + 0.5, F.col("s_suppkey") * 7 % 350 - 175 + 0.25
    side = 0.3 + F.col("s_suppkey") % 3
    names = geo.tile_names(west, south, west + side, south + side)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(names).alias("tile"))


def tagged_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5 m"))).when(F.col("p_partkey") % 3 == 1, F.lit("0"))
    levels = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("+"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.tagged_height(height, levels).alias("height"))


#: Paths of elevation files, by what names their source.
PATHS = ("/data/dem/cartodem/tile_", "/data/Copernicus_GLO30/", "/data/nasadem/n27e088_", "/dem/srtm_n27_", "/dem/cdng45e", "/dem/survey_")


def source_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % len(PATHS)
    path = F.concat(F.element_at(F.array(*map(F.lit, PATHS)), (k + 1).cast("int")), F.when(k == 4, "").otherwise(F.col("p_partkey").cast("string")), F.lit(".tif"))
    tag = F.when(F.col("p_partkey") % 7 == 0, "synthetic")
    source = rules.dem_source(path, tag)
    shift = rules.datum_shift(source, F.when(F.col("p_partkey") % 5 == 0, 2.5), F.when(F.col("p_size") > 25, -43.8), F.when(F.col("p_size") > 10, -40.0), F.lit(-46.0))
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), rules.datum(source).alias("datum"), shift.alias("shift"))


def zone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.col("c_custkey") % 702  # as many names as one or two letters give
    return table(spark, sf_dir, "customer").select("c_custkey", rules.zone_name(rank).alias("name"))


def shadow_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = rules.shadow_height(
        F.col("l_quantity"), F.lit(0.5), 20.0 + F.col("l_linenumber") * 8, F.col("l_discount") - 0.05, F.col("l_tax") * 300, F.col("l_suppkey") % 360.0
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", height.alias("h")).where("h IS NOT NULL")
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("h"), 3).alias("height"), F.round(F.max("h"), 6).alias("tallest"))


def time_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice") % 4000 / 100.0)
    rows = table(spark, sf_dir, "orders").select(rules.time_colour(minutes).alias("rgba"))
    return rows.groupBy(*[F.col("rgba")[k].alias(n) for k, n in enumerate(("red", "green", "blue", "alpha"))]).agg(F.count("*").alias("n"))


def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup on two grids: a place from 0 to 1 falls into a cell of either."""
    u, v = F.col("value") / 100.0, F.col("user_id") % 101 / 100.0
    return table(spark, sf_dir, "events").select(
        "event_id", geo.cell_at(u, 64).alias("c"), geo.cell_at(v, 500).alias("r"), geo.cell_at(u, 320).alias("c_fine"), geo.place_of(geo.cell_at(u, 64), 64).alias("u_mid")
    )


QUERIES = {
    f.__name__: f
    for f in (tobler_speed, sun_position, utm_places, tile_names, tagged_height, source_inference, zone_names, shadow_heights, time_colours, tile_lookup)
}

_PI = repr(math.pi)
_N = geo.FLATTENING / (2 - geo.FLATTENING)
_RADIUS = geo.AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)
_d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
_series = lambda base, f, g: base + "".join(f" + {_d(a)} * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, a in enumerate(_ALPHA, 1))
_ramp = lambda k: "CASE WHEN m <= 0 THEN " + str(rules.TIME_STOPS[0][1][k]) + "".join(
    f" WHEN m <= {x1} THEN {a[k]} + (m - {x0}) * {_d((b[k] - a[k]) / (x1 - x0))}" for (x0, a), (x1, b) in zip(rules.TIME_STOPS, rules.TIME_STOPS[1:], strict=False)
) + f" ELSE {rules.TIME_STOPS[-1][1][k]} END"

ORACLES = {
    "tobler_speed": """SELECT DISTINCT p AS slope_percent, round(6 * exp(CAST(-3.5 AS DOUBLE) * abs(p / CAST(100 AS DOUBLE) + CAST(0.05 AS DOUBLE))) / CAST(3.6 AS DOUBLE), 9) AS speed
        FROM (SELECT CAST(round((l_discount - l_tax) * 100) AS BIGINT) AS p FROM lineitem)""",
    "sun_position": f"""
        WITH a AS (SELECT event_id, user_id % 120 - CAST(60 AS DOUBLE) AS lat, user_id % 360 - CAST(180 AS DOUBLE) AS lon, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS sec FROM events),
        b AS (SELECT *, (sec / {_d(86400.0)} + {_d(2440587.5)} - {_d(2451545.0)}) / {_d(36525.0)} AS t FROM a),
        c AS (SELECT *, ({_d(280.46646)} + t * ({_d(36000.76983)} + {_d(0.0003032)} * t)) % 360 AS l0,
              radians({_d(357.52911)} + t * ({_d(35999.05029)} - {_d(0.0001537)} * t)) AS mr, {_d(0.016708634)} - t * ({_d(0.000042037)} + {_d(0.0000001267)} * t) AS e,
              radians({_d(125.04)} - {_d(1934.136)} * t) AS om FROM b),
        d AS (SELECT *, sin(mr) * ({_d(1.914602)} - t * ({_d(0.004817)} + {_d(0.000014)} * t)) + sin(2 * mr) * ({_d(0.019993)} - {_d(0.000101)} * t) + sin(3 * mr) * {_d(0.000289)} AS ctr,
              radians(23 + (26 + ({_d(21.448)} - t * ({_d(46.815)} + t * ({_d(0.00059)} - t * {_d(0.001813)}))) / 60) / 60 + {_d(0.00256)} * cos(om)) AS eps FROM c),
        f AS (SELECT *, asin(sin(eps) * sin(radians(l0 + ctr - {_d(0.00569)} - {_d(0.00478)} * sin(om)))) AS decl, pow(tan(eps / 2), 2) AS y, radians(l0) AS l FROM d),
        h AS (SELECT *, radians((floor(sec % 86400) / 60 + 4 * degrees(y * sin(2 * l) - 2 * e * sin(mr) + 4 * e * y * sin(mr) * cos(2 * l) - {_d(0.5)} * y * y * sin(4 * l) - {_d(1.25)} * e * e * sin(2 * mr))
              + 4 * lon + 1440) % 1440 / 4 - 180) AS ha, radians(lat) AS phi FROM f)
        SELECT event_id, round(90 - degrees(acos(greatest(-1.0, least(1.0, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(ha))))), 6) AS elevation,
               round((degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(decl) * cos(phi))) + 180) % 360, 5) AS azimuth FROM h""",
    "utm_places": f"""
        WITH a AS (SELECT c_custkey, c_custkey % 3590 / CAST(10 AS DOUBLE) - {_d(179.5)} AS lon, c_custkey % 160 - CAST(80 AS DOUBLE) AS lat FROM customer),
        b AS (SELECT *, radians(lat) AS phi, floor((lon + 180) / 6) + 1 AS zone FROM a),
        c AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(phi)) - {_d(_E)} * atanh({_d(_E)} * sin(phi))) AS t FROM b),
        d AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + pow(cos(lam), 2))) AS eta FROM c)
        SELECT c_custkey, CAST(zone + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS BIGINT) AS epsg,
               round(500000 + {_d(geo.UTM_SCALE * _RADIUS)} * ({_series("eta", "cos", "sinh")}), 3) AS easting,
               round(CASE WHEN lat < 0 THEN 10000000.0 ELSE 0 END + {_d(geo.UTM_SCALE * _RADIUS)} * ({_series("xi", "sin", "cosh")}), 3) AS northing FROM d""",
    "tile_names": """
        WITH a AS (SELECT s_suppkey, s_suppkey % 120 - 60 + 0.5 AS south, s_suppkey * 7 % 350 - 175 + 0.25 AS west, 0.3 + s_suppkey % 3 AS side FROM supplier)
        SELECT s_suppkey, 'Copernicus_DSM_COG_10_' || CASE WHEN y >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(y) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN x >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') || '_00_DEM' AS tile
        FROM (SELECT s_suppkey, west, side, unnest(range(CAST(floor(south) AS BIGINT), CAST(ceil(south + side) AS BIGINT))) AS y FROM a), LATERAL (SELECT unnest(range(CAST(floor(west) AS BIGINT), CAST(ceil(west + side) AS BIGINT))) AS x)""",
    "tagged_height": r"""
        WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '.5 m' WHEN 1 THEN '0' END AS h, CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_size || '+' ELSE p_brand END AS l FROM part),
        b AS (SELECT p_partkey, TRY_CAST(regexp_extract(h, '^\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS h, TRY_CAST(regexp_extract(l, '^\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS l FROM a)
        SELECT p_partkey, coalesce(nullif(h, 0), nullif(l, 0) * 3 + 1) AS height FROM b""",
    "source_inference": """
        WITH a AS (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part),
        b AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN 'synthetic' WHEN k = 0 THEN 'cartodem' WHEN k = 1 THEN 'copernicus_glo30' WHEN k = 2 THEN 'nasadem' WHEN k = 3 THEN 'srtm'
              WHEN k = 4 THEN 'cartodem' ELSE 'survey_' || p_partkey END AS source FROM a)
        SELECT p_partkey, source, CASE source WHEN 'cartodem' THEN 'WGS84 ellipsoid (CartoDEM V3R1)' WHEN 'copernicus_glo30' THEN 'EGM2008' WHEN 'nasadem' THEN 'EGM96' WHEN 'srtm' THEN 'EGM96'
              WHEN 'synthetic' THEN 'WGS84 ellipsoid (synthetic, CartoDEM-like)' ELSE 'unknown' END AS datum,
              CAST(CASE WHEN p_partkey % 5 = 0 THEN 2.5 WHEN source IN ('cartodem', 'synthetic') THEN CASE WHEN p_size > 25 THEN 43.8 WHEN p_size > 10 THEN 40 ELSE 46 END ELSE 0 END AS DOUBLE) AS shift FROM b""",
    "zone_names": """WITH a AS (SELECT c_custkey, c_custkey % 702 AS k FROM customer)
        SELECT c_custkey, CASE WHEN k < 26 THEN chr(CAST(65 + k AS INTEGER)) ELSE chr(CAST(64 + k // 26 AS INTEGER)) || chr(CAST(65 + k % 26 AS INTEGER)) END AS name FROM a""",
    "shadow_heights": f"""
        WITH a AS (SELECT l_linenumber, l_quantity AS len, tan(radians(20.0 + l_linenumber * 8)) AS tn, l_discount - {_d(0.05)} AS along, tan(radians(l_tax * 300)) * cos(radians(CAST(l_suppkey % 360 AS DOUBLE))) AS lean FROM lineitem),
        b AS (SELECT *, greatest(tn + along, {_d(0.2)} * tn) AS k FROM a), c AS (SELECT *, 1 / k - lean AS per FROM b), d AS (SELECT *, len * {_d(0.5)} / per AS h FROM c WHERE per >= {_d(0.15)} / k)
        SELECT l_linenumber, count(*) AS n, round(sum(h), 3) AS height, round(max(h), 6) AS tallest FROM d WHERE h >= 2 GROUP BY l_linenumber""",
    "time_colours": f"""
        WITH a AS (SELECT CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 4000 / CAST(100 AS DOUBLE) END AS m FROM orders),
        b AS (SELECT CASE WHEN m IS NULL THEN 90 ELSE CAST(floor({_ramp(0)}) AS INTEGER) END AS red, CASE WHEN m IS NULL THEN 0 ELSE CAST(floor({_ramp(1)}) AS INTEGER) END AS green,
              CASE WHEN m IS NULL THEN 120 ELSE CAST(floor({_ramp(2)}) AS INTEGER) END AS blue, CASE WHEN m IS NULL THEN 200 ELSE 150 END AS alpha FROM a)
        SELECT red, green, blue, alpha, count(*) AS n FROM b GROUP BY ALL""",
    "tile_lookup": """
        WITH a AS (SELECT event_id, value / CAST(100 AS DOUBLE) AS u, user_id % 101 / CAST(100 AS DOUBLE) AS v FROM events),
        b AS (SELECT event_id, greatest(0, least(63, CAST(trunc(u * 64) AS BIGINT))) AS c, greatest(0, least(499, CAST(trunc(v * 500) AS BIGINT))) AS r, greatest(0, least(319, CAST(trunc(u * 320) AS BIGINT))) AS c_fine FROM a)
        SELECT event_id, c, r, c_fine, (c + CAST(0.5 AS DOUBLE)) / 64 AS u_mid FROM b""",
}
