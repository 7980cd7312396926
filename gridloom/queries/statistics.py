"""Accuracy metrics, robust fits and other aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours
from ..operators import statistics as st
from ..sources.grid import grid
from ..storage import table
from . import GRID


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as measured against reference heights."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select("l_returnflag", F.col("l_extendedprice").alias("pred"), (F.col("l_quantity") * F.col("p_retailprice")).alias("ref"))
    return _rounded(st.accuracy(pairs, ["l_returnflag"]), 4, "rmse", "mae", "bias", "r", "nmad", "rmse_shift_free")


def validation_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select(
        F.col("l_extendedprice").alias("dsm"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dem"), (F.col("l_quantity") * F.col("p_retailprice")).alias("ref"), "p_size"
    )
    return _rounded(st.compared(pairs, ["dsm", "dem"], "ref", F.col("p_size") > 25), 4, "rmse", "mae", "bias", "r", "nmad", "rmse_shift_free")


def percentile_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir)
    ends = cells.agg(F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    ends = ends.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))  # one row
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return cells.crossJoin(F.broadcast(ends)).groupBy(F.floor(share * 255).alias("byte")).agg(F.count("*").alias("n"))


def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = table(spark, sf_dir, "embeddings").count()
    return neighbours.block_mean(grid(spark, sf_dir), "z", 7, height, 64).select("r", "c", F.round("z", 8).alias("z"))


def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = st.affine(_pairs(spark, sf_dir), ["p_brand"], "l_quantity", "l_extendedprice")
    return _rounded(fit, 4, "a", "b")


def trimmed_affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = st.trimmed_affine(_pairs(spark, sf_dir).select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return _rounded(fit, 4, "a", "b")


def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("band", F.expr("r div 100"))
    return _rounded(st.plane(cells, ["band"], "c", "r", "z"), 6, "p0", "p1", "p2")


def band_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("p_brand", (F.col("l_quantity") - 25.5).alias("d"), (F.col("l_extendedprice") - 25000).alias("e"))
    fit = st.band_scale(rows, ["p_brand"], "d", "e")
    usable = (F.col("n") >= 64) & (F.col("r") >= 0.1) & (F.col("s") > 0)
    return _rounded(fit.withColumn("usable", usable), 6, "s", "r")


def datum_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median shift between two elevation models by row of cells, accepted where it is large and even."""
    cells = grid(spark, sf_dir).select(F.expr("r div 10").alias("band"), (F.col("z") % 40 - 45 + F.when(F.col("r") % 3 == 0, 60).otherwise(0)).alias("d"))
    med = cells.groupBy("band").agg(F.median("d").alias("offset"), F.count("*").alias("n"))
    spread = cells.join(med, "band").groupBy("band").agg((st.NMAD * F.median(F.abs(F.col("d") - F.col("offset")))).alias("nmad"))
    good = (F.col("n") >= 100) & (F.abs("offset") >= 10) & (F.col("nmad") < F.abs("offset") / 2)
    return med.join(spread, "band").select("band", "n", "offset", F.round("nmad", 6).alias("nmad"), good.alias("accepted"))


def ground_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres per relative unit on buildings, by region of rows; groups under twenty cells have none."""
    cells = grid(spark, sf_dir).where("z > 120").select(F.expr("r div 50").alias("band"), (F.col("z") * 3 / (F.col("z") + F.col("c"))).alias("k"))
    return cells.groupBy("band").agg(F.count("*").alias("n"), F.median("k").alias("k")).select("band", "n", F.round(F.when(F.col("n") >= 20, F.col("k")), 8).alias("k"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(
        "p_brand", "l_orderkey", "l_linenumber", (F.col("p_size") / 50.0).alias("rel"), (F.col("p_retailprice") / 20).alias("h"), F.col("l_quantity").alias("w"), (F.col("l_discount") * 200).alias("spread")
    )


def weighted_median_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _anchors(spark, sf_dir).withColumn("k", F.col("h") / F.col("rel"))
    return _rounded(st.weighted_median(rows, ["p_brand"], "k", "w"), 8, "wmedian")


def robust_fit_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir)
    fit, loo = st.robust_scale(anchors, ["p_brand"]), st.leave_one_out(anchors, ["p_brand"])
    return _rounded(fit.join(loo, "p_brand"), 5, "scale", "loo_rmse", "loo_mae")


def anchor_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = st.clean_anchors(_anchors(spark, sf_dir), ["p_brand"], tallest=90.0)
    return kept.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.max("h"), 6).alias("tallest"))


def anchor_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the heights of one building the mapped one wins, then the last."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_shipdate").isNotNull() & (F.col("l_returnflag") == "R")).cast("int").alias("mapped"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_extendedprice")
    return st.latest_wins(rows, ["l_partkey"], "mapped", "seq").drop("mapped")


def scale_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir).select(
        "p_brand", (F.col("l_orderkey") % 96).alias("row"), (F.col("l_linenumber") * 9).alias("col"), (F.col("h") / F.col("rel")).alias("k"), "w", F.lit(80.0).alias("scale")
    )
    return _rounded(st.kernel_field(anchors, ["p_brand"], 96, 64), 8, "factor")


def tta_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of a cell over four views of the grid (as it is, and turned by rows of four)."""
    views = grid(spark, sf_dir).select("r", "c", "z", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    at = views.select("r", F.when(F.col("k") % 2 == 1, 63 - F.col("c")).otherwise(F.col("c")).alias("c"), (F.col("z") + F.when(F.col("k") >= 2, F.col("c")).otherwise(0)).alias("v"))
    return at.groupBy("r", "c").agg(F.avg("v").alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


def confidence_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") % 3).cast("int").alias("v"))
    return rows.groupBy("event_type").agg(*[F.avg((F.col("v") == k).cast("int")).alias(n) for k, n in enumerate(("red", "amber", "green"))])


def fusion_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrinkage of model heights towards the anchors' median: correlation, median, error of the shrunk heights."""
    rows = _anchors(spark, sf_dir)
    stats = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.corr("rel", "h").alias("cor"), F.median("h").alias("med"), F.stddev_pop("rel").alias("sr"), F.stddev_pop("h").alias("sh"))
    rho = F.when((F.col("n") >= 8) & (F.col("sr") > 0) & (F.col("sh") > 0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("cor", F.lit(0.0)), F.lit(0.0)))).otherwise(1.0)
    model = rows.join(stats.withColumn("rho", rho), "p_brand")
    off = F.col("med") + F.col("rho") * (80 * F.col("rel") - F.col("med")) - F.col("h")
    return model.groupBy("p_brand").agg(F.round(F.max("rho"), 6).alias("rho"), F.round(F.max("med"), 6).alias("med"), F.round(F.sqrt(F.avg(off * off)), 5).alias("rmse"))


def zone_overload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as zones: people assigned against capacity, with names in order."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("people"))
    zones = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.count("*") * 14).alias("capacity"))
    both = zones.join(people, "zone", "left").withColumn("people", F.coalesce("people", F.lit(0)))
    return both.select("zone", "people", "capacity", (F.col("people") > F.col("capacity")).alias("overloaded"))


QUERIES = {
    f.__name__: f
    for f in (
        validation_metrics, validation_by_subset, percentile_stretch, block_mean, affine_fit, trimmed_affine_fit, plane_fit, band_scale, datum_offset, ground_scale, weighted_median_scale,
        robust_fit_loo, anchor_cleaning, anchor_latest_wins, scale_field, tta_mean_std, confidence_shares, fusion_statistics, zone_overload,
    )
}

_PAIRS = "SELECT l.*, p_retailprice, p_size, p_brand FROM lineitem l JOIN part ON l_partkey = p_partkey"
_METRICS = """round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)), 4) AS mae, round(avg(d), 4) AS bias, round(corr(pred, ref), 4) AS r,
    round(CAST('1.4826' AS DOUBLE) * median(abs(d - med)), 4) AS nmad, round(sqrt(avg((d - med) * (d - med))), 4) AS rmse_shift_free"""
_ANCHORS = f"""a AS (SELECT p_brand, l_orderkey, l_linenumber, p_size / CAST(50 AS DOUBLE) AS rel, p_retailprice / 20 AS h, l_quantity AS w, l_discount * 200 AS spread FROM ({_PAIRS}))"""


def _wmedian(source: str, name: str) -> str:
    return f"""{name}f AS (SELECT p_brand, k, sum(w) AS w FROM {source} GROUP BY p_brand, k),
        {name}c AS (SELECT p_brand, k, sum(w) OVER (PARTITION BY p_brand ORDER BY k) AS cw, sum(w) OVER (PARTITION BY p_brand) AS tw FROM {name}f),
        {name} AS (SELECT p_brand, min(k) AS m FROM {name}c WHERE cw >= tw / 2 GROUP BY p_brand)"""


ORACLES = {
    "validation_metrics": f"""WITH a AS (SELECT l_returnflag, l_extendedprice AS pred, l_quantity * p_retailprice AS ref FROM ({_PAIRS})), d AS (SELECT *, pred - ref AS d FROM a),
        m AS (SELECT *, median(d) OVER (PARTITION BY l_returnflag) AS med FROM d) SELECT l_returnflag, count(*) AS n, {_METRICS} FROM m GROUP BY l_returnflag""",
    "validation_by_subset": f"""WITH p AS ({_PAIRS}), a AS (SELECT 'dsm' AS surface, l_extendedprice AS pred, l_quantity * p_retailprice AS ref, p_size FROM p UNION ALL
            SELECT 'dem', l_extendedprice * (1 - l_discount), l_quantity * p_retailprice, p_size FROM p),
        b AS (SELECT *, 'all' AS subset FROM a UNION ALL SELECT *, 'objects' FROM a WHERE p_size > 25), d AS (SELECT *, pred - ref AS d FROM b),
        m AS (SELECT *, median(d) OVER (PARTITION BY surface, subset) AS med FROM d) SELECT surface, subset, count(*) AS n, {_METRICS} FROM m GROUP BY surface, subset""",
    "percentile_stretch": f"""WITH {GRID}, e AS (SELECT quantile_cont(CAST(z AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(z AS DOUBLE), 0.98) AS hi FROM g)
        SELECT CAST(floor(greatest(0.0, least(1.0, (z - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo))) * 255) AS BIGINT) AS byte, count(*) AS n FROM g, e GROUP BY 1""",
    "block_mean": f"""WITH {GRID}, h AS (SELECT count(*) // 7 * 7 AS h FROM embeddings)
        SELECT r // 7 AS r, c // 7 AS c, round(avg(z), 8) AS z FROM g, h WHERE r < h AND c < 63 GROUP BY 1, 2""",
    "affine_fit": f"SELECT p_brand, round(regr_slope(l_extendedprice, l_quantity), 4) AS a, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b FROM ({_PAIRS}) GROUP BY p_brand",
    "trimmed_affine_fit": f"""WITH p AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM ({_PAIRS})),
        m AS (SELECT *, median(x) OVER (PARTITION BY g) AS mx, median(y) OVER (PARTITION BY g) AS my FROM p),
        f0 AS (SELECT g, any_value(mx) AS mx, any_value(my) AS my, CASE WHEN median(abs(x - mx)) > 0.000000001 THEN median(abs(y - my)) / median(abs(x - mx)) ELSE 0 END AS a FROM m GROUP BY g),
        f1 AS (SELECT g, a, my - a * mx AS b FROM f0),
        r1 AS (SELECT p.*, abs(a * x + b - y) AS res, quantile_cont(abs(a * x + b - y), 0.95) OVER (PARTITION BY p.g) AS cut FROM p JOIN f1 USING (g)),
        f2 AS (SELECT g, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r1 WHERE res <= cut GROUP BY g),
        r2 AS (SELECT p.*, abs(a * x + b - y) AS res, quantile_cont(abs(a * x + b - y), 0.95) OVER (PARTITION BY p.g) AS cut FROM p JOIN f2 USING (g))
        SELECT g AS l_returnflag, round(regr_slope(y, x), 4) AS a, round(regr_intercept(y, x), 4) AS b FROM r2 WHERE res <= cut GROUP BY g""",
    "plane_fit": f"""WITH {GRID}, b AS (SELECT r // 100 AS band, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM g),
        m AS (SELECT band, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM b GROUP BY band),
        s AS (SELECT band, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz,
              any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz FROM b JOIN m USING (band) GROUP BY band),
        p AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS p1, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS p2 FROM s)
        SELECT band, round(mz - p1 * mx - p2 * my, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM p""",
    "band_scale": f"""WITH a AS (SELECT p_brand, l_quantity - CAST(25.5 AS DOUBLE) AS d, l_extendedprice - 25000 AS e FROM ({_PAIRS})),
        b AS (SELECT p_brand, sum(d * e) / sum(d * d) AS s, corr(e, d) AS r, count(*) AS n FROM a GROUP BY p_brand)
        SELECT p_brand, round(s, 6) AS s, round(r, 6) AS r, n, n >= 64 AND r >= 0.1 AND s > 0 AS usable FROM b""",
    "datum_offset": f"""WITH {GRID}, a AS (SELECT r // 10 AS band, z % 40 - 45 + CASE WHEN r % 3 = 0 THEN 60 ELSE 0 END AS d FROM g), m AS (SELECT *, median(d) OVER (PARTITION BY band) AS med FROM a),
        b AS (SELECT band, count(*) AS n, CAST(any_value(med) AS DOUBLE) AS off, CAST('1.4826' AS DOUBLE) * median(abs(d - med)) AS nmad FROM m GROUP BY band)
        SELECT band, n, off AS "offset", round(nmad, 6) AS nmad, n >= 100 AND abs(off) >= 10 AND nmad < abs(off) / 2 AS accepted FROM b""",
    "ground_scale": f"""WITH {GRID} SELECT r // 50 AS band, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN median(CAST(z * 3 AS DOUBLE) / (z + c)) END, 8) AS k FROM g WHERE z > 120 GROUP BY 1""",
    "weighted_median_scale": f"WITH {_ANCHORS}, q AS (SELECT p_brand, h / rel AS k, w FROM a), {_wmedian('q', 'm')} SELECT p_brand, round(m, 8) AS wmedian FROM m",
    "robust_fit_loo": f"""WITH {_ANCHORS}, q AS (SELECT p_brand, rel, h, h / rel AS k, w, row_number() OVER () AS id FROM a WHERE rel > 0.005 AND h > 0), {_wmedian("q", "m")},
        v AS (SELECT q.*, abs(k - m) AS off, m FROM q JOIN m USING (p_brand)), s AS (SELECT p_brand, median(off) AS mad, count(*) AS n FROM v GROUP BY p_brand),
        i AS (SELECT v.*, n FROM v JOIN s USING (p_brand) WHERE off <= greatest(3 * CAST('1.4826' AS DOUBLE) * mad, 0.25 * m)), {_wmedian("i", "m2")},
        x AS (SELECT p_brand, count(*) AS inliers, any_value(n) AS n FROM i GROUP BY p_brand),
        lw AS (SELECT DISTINCT p_brand, k, w FROM q),
        lc AS (SELECT lw.p_brand, lw.k AS own, lw.w AS ow, f.k, sum(f.w - CASE WHEN f.k = lw.k THEN lw.w ELSE 0 END) OVER (PARTITION BY lw.p_brand, lw.k, lw.w ORDER BY f.k) AS cw,
               sum(f.w - CASE WHEN f.k = lw.k THEN lw.w ELSE 0 END) OVER (PARTITION BY lw.p_brand, lw.k, lw.w) AS tw, f.w - CASE WHEN f.k = lw.k THEN lw.w ELSE 0 END AS fw FROM lw JOIN mf f USING (p_brand)),
        lm AS (SELECT p_brand, own, ow, min(k) AS m FROM lc WHERE fw > 0 AND cw >= tw / 2 GROUP BY ALL),
        le AS (SELECT q.p_brand, lm.m * rel - h AS e FROM q JOIN lm ON lm.p_brand = q.p_brand AND own = k AND ow = w)
        SELECT p_brand, round(m2.m, 5) AS scale, inliers, n, loo_rmse, loo_mae FROM m2 JOIN x USING (p_brand)
        JOIN (SELECT p_brand, round(sqrt(avg(e * e)), 5) AS loo_rmse, round(avg(abs(e)), 5) AS loo_mae FROM le GROUP BY p_brand) USING (p_brand)""",
    "anchor_cleaning": f"""WITH {_ANCHORS}, b AS (SELECT *, median(h) OVER (PARTITION BY p_brand) AS med, count(*) OVER (PARTITION BY p_brand) AS n FROM a WHERE h <= 90 AND spread <= greatest(6.0, CAST(0.5 AS DOUBLE) * h)),
        d AS (SELECT *, median(abs(h - med)) OVER (PARTITION BY p_brand) AS mad FROM b)
        SELECT p_brand, count(*) AS n, round(max(h), 6) AS tallest FROM d WHERE n < 8 OR h <= med + 5 * greatest(mad, 1.0) GROUP BY p_brand""",
    "anchor_latest_wins": """SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_orderkey * 10 + l_linenumber DESC) = 1""",
    "scale_field": f"""WITH {_ANCHORS}, b AS (SELECT p_brand, l_orderkey % 96 AS row, l_linenumber * 9 AS col, h / rel AS k, w FROM a),
        n AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM range(3) t(i), range(2) u(j)),
        d AS (SELECT p_brand, i, j, k, w * exp(-(pow((i + CAST(0.5 AS DOUBLE)) * 32 - row, 2) + pow((j + CAST(0.5 AS DOUBLE)) * 32 - col, 2)) / 1664) AS kw FROM b, n)
        SELECT p_brand, i, j, round(exp(sum(kw * ln(k / 80)) / (sum(kw) + 3)), 8) AS factor FROM d GROUP BY p_brand, i, j""",
    "tta_mean_std": f"""WITH {GRID}, v AS (SELECT r, CASE WHEN k % 2 = 1 THEN 63 - c ELSE c END AS c, z + CASE WHEN k >= 2 THEN c ELSE 0 END AS v FROM g, range(4) t(k))
        SELECT r, c, avg(v) AS mean, round(stddev_pop(v), 6) AS std FROM v GROUP BY r, c""",
    "confidence_shares": """WITH a AS (SELECT event_type, CAST(floor(value % 3) AS INTEGER) AS v FROM events)
        SELECT event_type, avg(CAST(v = 0 AS INTEGER)) AS red, avg(CAST(v = 1 AS INTEGER)) AS amber, avg(CAST(v = 2 AS INTEGER)) AS green FROM a GROUP BY event_type""",
    "fusion_statistics": f"""WITH {_ANCHORS}, s AS (SELECT p_brand, greatest(0.0, corr(rel, h)) AS rho, median(h) AS med FROM a GROUP BY p_brand),
        m AS (SELECT a.p_brand, rho, med, med + rho * (80 * rel - med) - h AS off FROM a JOIN s USING (p_brand))
        SELECT p_brand, round(max(rho), 6) AS rho, round(max(med), 6) AS med, round(sqrt(avg(off * off)), 5) AS rmse FROM m GROUP BY p_brand""",
    "zone_overload": """WITH p AS (SELECT c_nationkey AS zone, count(*) AS people FROM customer GROUP BY 1), z AS (SELECT s_nationkey AS zone, count(*) * 14 AS capacity FROM supplier GROUP BY 1)
        SELECT zone, coalesce(people, 0) AS people, capacity, coalesce(people, 0) > capacity AS overloaded FROM z LEFT JOIN p USING (zone)""",
}
