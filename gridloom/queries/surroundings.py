"""Neighbourhood, morphology and tiling operators over the grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terrain as rules
from ..operators import neighbours as nb
from ..sources.grid import grid
from ..storage import table
from . import GRID, OFFSETS


def _height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def neighbour_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.gradient(grid(spark, sf_dir), "z").select("r", "c", "gr", "gc")


def hillshade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.hillshade(grid(spark, sf_dir), "z", 200.0).select("r", "c", F.round("shade", 7).alias("shade"))


def box_local_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.local_std(grid(spark, sf_dir), "z", 5, _height(spark, sf_dir), 64).select("r", "c", F.round("std", 6).alias("std"))


def gaussian_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.gaussian(grid(spark, sf_dir), "z", 1.0, _height(spark, sf_dir), 64).select("r", "c", F.round("z", 6).alias("z"))


def dilate_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = nb.dilate(grid(spark, sf_dir).withColumn("m", F.col("z") > 150), "m", 2)
    return grown.select("r", "c", F.col("m").cast("int").alias("m"))


def open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening takes away peaks, closing fills pits; the ground surface is the opened grid."""
    cells = grid(spark, sf_dir).withColumn("closed", F.col("z"))
    both = nb.closed(nb.opened(cells, "z", 3), "closed", 5)
    return both.select("r", "c", F.col("z").alias("opened"), "closed")


def max_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.extreme(grid(spark, sf_dir), "z", 4).select("r", "c", "z")


def tile_hopping_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles, each with an offset of its own, blended by Hann weights."""
    tiles = nb.tiled(grid(spark, sf_dir), 24, 12, _height(spark, sf_dir), 64)
    values = tiles.withColumn("v", F.col("z") + F.col("tr") % 5 + F.col("tc") % 7)
    return nb.blended(values, "v").select("r", "c", F.round("v", 6).alias("v"))


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v"))
    return nb.otsu(grey, "v", by="event_type")


def seam_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.seam_ratio(grid(spark, sf_dir), "z", [16, 32, 48]).select("ratio")


def d8_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.receivers(grid(spark, sf_dir)).select("r", "c", "to_r", "to_c")


def area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb.resampled(grid(spark, sf_dir), "z", _height(spark, sf_dir), 64, 48, 24).select("r", "c", F.round("z", 6).alias("z"))


def shadow_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark cells: blurred brightness under the lower of Otsu's threshold and three fifths of the median."""
    cells = grid(spark, sf_dir).select("scene", "r", "c", (F.abs("z") % 256).alias("v"))
    blurred = nb.box_mean(cells, "v", 3, _height(spark, sf_dir), 64)
    levels = nb.otsu(cells, "v").crossJoin(F.broadcast(cells.agg(F.median("v").alias("med"))))  # one row each
    dark = blurred.crossJoin(F.broadcast(levels.select("threshold", "med"))).where(F.col("v") < F.least(F.col("threshold").cast("double"), 0.6 * F.col("med")))
    return dark.groupBy("r").agg(F.count("*").alias("n"))


def height_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shaded colour ramp from the 1st to the 99th percentile."""
    cells = nb.hillshade(grid(spark, sf_dir), "z", 200.0)
    ends = cells.agg(F.percentile("z", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))  # one row
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - F.col("p")[0]) / (F.col("p")[1] - F.col("p")[0])))
    lit = rules.ramp(share, [(0.0, 30.0), (0.5, 200.0), (1.0, 90.0)]) * (0.45 + 0.65 * F.col("shade"))
    return cells.crossJoin(F.broadcast(ends)).groupBy("r").agg(F.round(F.sum(F.least(lit, F.lit(255.0))), 4).alias("brightness"))


QUERIES = {
    f.__name__: f
    for f in (
        neighbour_gradient, hillshade, box_local_std, gaussian_filter, dilate_mask, open_close, max_filter, tile_hopping_blend, otsu_threshold, seam_ratio, d8_receivers, area_resize,
        shadow_predicate, height_colours,
    )
}

_H = "h AS (SELECT count(*) AS h FROM embeddings)"
_GRADIENT = """d AS (SELECT r, c, z,
        CAST(coalesce(lead(z) OVER cr, z) - coalesce(lag(z) OVER cr, z) AS DOUBLE) / CASE WHEN lead(z) OVER cr IS NULL OR lag(z) OVER cr IS NULL THEN 1 ELSE 2 END AS gr,
        CAST(coalesce(lead(z) OVER cc, z) - coalesce(lag(z) OVER cc, z) AS DOUBLE) / CASE WHEN lead(z) OVER cc IS NULL OR lag(z) OVER cc IS NULL THEN 1 ELSE 2 END AS gc
        FROM g WINDOW cr AS (PARTITION BY c ORDER BY r), cc AS (PARTITION BY r ORDER BY c))"""
_SHADE = f"""{_GRADIENT}, w AS (SELECT r, c, z, gr / 200 AS y, gc / 200 AS x FROM d),
    shaded AS (SELECT r, c, z, greatest(0.0, least(1.0, (-x * sin(radians(315.0)) * cos(radians(45.0)) + y * cos(radians(315.0)) * cos(radians(45.0)) + sin(radians(45.0))) / sqrt(x * x + y * y + 1))) AS shade FROM w)"""
#: A place beyond the border stands for its mirror image.
_mirror = lambda x, n: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"
_box = lambda half, value, source="g": f"""(SELECT a.r, a.c, {value} FROM {source} a, h, range(-{half}, {half + 1}) t(i), range(-{half}, {half + 1}) u(j), {source} b  # noqa: E731
    WHERE b.r = {_mirror('a.r + i', 'h')} AND b.c = {_mirror('a.c + j', '64')} GROUP BY a.r, a.c)""".replace("  # noqa: E731", "")


def _near(k_before: int, k_after: int, pick: str, source: str, name: str) -> str:
    frame = f"ROWS BETWEEN {k_before} PRECEDING AND {k_after} FOLLOWING"
    return f"""{name}1 AS (SELECT r, c, {pick}(z) OVER (PARTITION BY r ORDER BY c {frame}) AS z FROM {source}),
        {name} AS (SELECT r, c, {pick}(z) OVER (PARTITION BY c ORDER BY r {frame}) AS z FROM {name}1)"""


def _box_sums(source: str, values: str, half: int, name: str) -> str:
    """Sums of ``values`` over boxes of 2 half + 1 cells a side, mirrored at the borders, by windows over a padded table."""
    columns, total = ", ".join(values.split()), ", ".join(f"sum({v}) OVER w AS {v}" for v in values.split())
    frame = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    return f"""{name}1 AS (SELECT r, c, {columns} FROM {source} UNION ALL SELECT r, -1 - c, {columns} FROM {source} WHERE c < {half} UNION ALL SELECT r, 127 - c, {columns} FROM {source} WHERE c >= 64 - {half}),
        {name}2 AS MATERIALIZED (SELECT * FROM (SELECT r, c, {total} FROM {name}1 WINDOW w AS (PARTITION BY r ORDER BY c {frame})) WHERE c BETWEEN 0 AND 63),
        {name}3 AS (SELECT r, c, {columns} FROM {name}2 UNION ALL SELECT -1 - r, c, {columns} FROM {name}2 WHERE r < {half} UNION ALL SELECT 2 * h - 1 - r, c, {columns} FROM {name}2, h WHERE r >= h - {half}),
        {name} AS MATERIALIZED (SELECT x.* FROM (SELECT r, c, {total} FROM {name}3 WINDOW w AS (PARTITION BY c ORDER BY r {frame})) x, h WHERE r BETWEEN 0 AND h - 1)"""


_kernel = [math.exp(-0.5 * k * k) for k in range(-4, 5)]
_TAPER = "CASE WHEN {s} = 0 AND {p} - {s} < 12 THEN 1.0 WHEN {s} + 24 >= {n} AND {p} - {s} >= 12 THEN 1.0 ELSE pow(sin(pi() * ({p} - {s} + 0.5) / 24), 2) END"
_ORIGINS = "list_distinct(list_append(range(0, {n} - 24, 12), {n} - 24))"
_OTSU = """c AS (SELECT k, v, count(*) AS n FROM v GROUP BY k, v),
    u AS (SELECT k, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY k) AS n, sum(n * v) OVER (PARTITION BY k) AS s FROM c WINDOW w AS (PARTITION BY k ORDER BY v)),
    b AS (SELECT k, v, CAST(n0 AS DOUBLE) * CAST(n - n0 AS DOUBLE) * pow(CAST(s0 AS DOUBLE) / CAST(n0 AS DOUBLE) - CAST(s - s0 AS DOUBLE) / CAST(n - n0 AS DOUBLE), 2) AS between_ FROM u WHERE n0 < n),
    otsu AS (SELECT k, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY between_ DESC, v) = 1)"""

ORACLES = {
    "neighbour_gradient": f"WITH {GRID}, {_GRADIENT} SELECT r, c, gr, gc FROM d",
    "hillshade": f"WITH {GRID}, {_SHADE} SELECT r, c, round(shade, 7) AS shade FROM shaded",
    "box_local_std": f"WITH {GRID}, {_H}, x AS {_box(2, 'avg(b.z) AS m, sum(b.z * b.z) / CAST(25 AS DOUBLE) AS q')} SELECT r, c, round(sqrt(greatest(q - m * m, 0)), 6) AS std FROM x",
    "gaussian_filter": f"""WITH {GRID}, {_H}, k(i, w) AS (VALUES {", ".join(f"({i - 4}, CAST('{w / sum(_kernel)!r}' AS DOUBLE))" for i, w in enumerate(_kernel))}),
        x AS (SELECT a.r, a.c, sum(b.z * w) AS z FROM g a, k, g b WHERE b.r = a.r AND b.c = {_mirror("a.c + i", "64")} GROUP BY a.r, a.c)
        SELECT a.r, a.c, round(sum(b.z * w), 6) AS z FROM x a, h, k, x b WHERE b.c = a.c AND b.r = {_mirror("a.r + i", "h")} GROUP BY a.r, a.c""",
    "dilate_mask": f"""WITH {GRID} SELECT a.r, a.c, CAST(EXISTS (SELECT 1 FROM g b, range(-2, 3) t(i) WHERE b.z > 150 AND b.r = a.r + i AND b.c BETWEEN a.c - (2 - abs(i)) AND a.c + (2 - abs(i))) AS INTEGER) AS m FROM g a""",
    "open_close": f"""WITH {GRID}, {_near(1, 1, "min", "g", "a")}, {_near(1, 1, "max", "a", "b")}, {_near(2, 2, "max", "g", "p")}, {_near(2, 2, "min", "p", "q")}
        SELECT r, c, b.z AS opened, q.z AS closed FROM b JOIN q USING (r, c)""",
    "max_filter": f"WITH {GRID}, {_near(2, 1, 'max', 'g', 'm')} SELECT r, c, z FROM m",
    "tile_hopping_blend": f"""WITH {GRID}, {_H}, tr AS (SELECT unnest({_ORIGINS.format(n="h")}) AS tr, h FROM h), tc AS (SELECT unnest({_ORIGINS.format(n="64")}) AS tc),
        t AS (SELECT r, c, z + tr % 5 + tc % 7 AS v, {_TAPER.format(s="tr", p="r", n="h")} * {_TAPER.format(s="tc", p="c", n="64")} + CAST(0.000001 AS DOUBLE) AS w
              FROM g JOIN tr ON r >= tr AND r < tr + 24 JOIN tc ON c >= tc AND c < tc + 24)
        SELECT r, c, round(sum(v * w) / sum(w), 6) AS v FROM t GROUP BY r, c""",
    "otsu_threshold": f"WITH v AS (SELECT event_type AS k, CAST(floor(value) AS BIGINT) AS v FROM events), {_OTSU} SELECT k AS event_type, threshold FROM otsu",
    "seam_ratio": f"""WITH {GRID}, d AS (SELECT abs(z - lag(z) OVER (PARTITION BY r ORDER BY c)) AS d, c IN (16, 32, 48) AS seam FROM g UNION ALL SELECT abs(z - lag(z) OVER (PARTITION BY c ORDER BY r)), r IN (16, 32, 48) FROM g)
        SELECT avg(d) FILTER (seam) / avg(d) FILTER (NOT seam) AS ratio FROM d WHERE d IS NOT NULL""",
    "d8_receivers": f"""WITH {GRID}, {OFFSETS}, a AS (SELECT r, c, z, k, dr, dc, r + dr AS to_r, c + dc AS to_c FROM g, o),
            f AS (SELECT a.r, a.c, to_r, to_c, row_number() OVER (PARTITION BY a.r, a.c ORDER BY CAST(a.z - b.z AS DOUBLE) / sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) DESC, k) AS n
            FROM a JOIN g b ON b.r = to_r AND b.c = to_c WHERE a.z > b.z)
        SELECT g.r, g.c, to_r, to_c FROM g LEFT JOIN f ON f.r = g.r AND f.c = g.c AND n = 1""",
    "area_resize": f"""WITH {GRID}, {_H}, rr AS (SELECT r, i, least((r + 1) * 48 / CAST(h AS DOUBLE), i + 1) - greatest(r * 48 / CAST(h AS DOUBLE), i) AS w FROM (SELECT DISTINCT r FROM g), h, range(48) t(i) WHERE (r + 1) * 48 > i * h AND r * 48 < (i + 1) * h),
        cc AS (SELECT c, j, least((c + 1) * 24 / CAST(64 AS DOUBLE), j + 1) - greatest(c * 24 / CAST(64 AS DOUBLE), j) AS w FROM range(64) u(c), range(24) t(j) WHERE (c + 1) * 24 > j * 64 AND c * 24 < (j + 1) * 64)
        SELECT i AS r, j AS c, round(sum(z * rr.w * cc.w) / sum(rr.w * cc.w), 6) AS z FROM g JOIN rr USING (r) JOIN cc USING (c) GROUP BY i, j""",
    "shadow_predicate": f"""WITH {GRID}, {_H}, y AS (SELECT r, c, abs(z) % 256 AS z FROM g), v AS (SELECT 0 AS k, z AS v FROM y), {_OTSU}, l AS (SELECT least(CAST(threshold AS DOUBLE), CAST(0.6 AS DOUBLE) * (SELECT median(z) FROM y)) AS lim FROM otsu),
        x AS {_box(1, "sum(b.z) AS z", "y")} SELECT r, count(*) AS n FROM x, l WHERE z / CAST(9 AS DOUBLE) < lim GROUP BY r""",
    "height_colours": f"""WITH {GRID}, {_SHADE}, p AS (SELECT quantile_cont(CAST(z AS DOUBLE), 0.01) AS lo, quantile_cont(CAST(z AS DOUBLE), 0.99) AS hi FROM g),
        s AS (SELECT r, shade, greatest(0.0, least(1.0, (z - lo) / (hi - lo))) AS s FROM shaded, p)
        SELECT r, round(sum(least(255.0, CASE WHEN s <= 0.5 THEN 30 + s * 340 ELSE 200 + (s - 0.5) * -220 END * (CAST(0.45 AS DOUBLE) + CAST(0.65 AS DOUBLE) * shade))), 4) AS brightness FROM s GROUP BY r""",
}
