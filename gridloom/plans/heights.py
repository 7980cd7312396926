"""From an image and relative heights to metres: calibration of any number of scenes in one plan.

What is known differs from scene to scene.  Every choice between sources (of the sun, the scale, the ground) is a
coalesce over a scene's row, and a scene without any scale stays relative; no choice is taken on the driver.  Scenes of
a run share their size in pixels and the widths of filters in cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solar
from ..functions import terrain as rules
from ..operators import calibration as cal
from ..operators import graph, regrid, roofs
from ..operators import neighbours as nb
from ..operators import statistics as st
from ..storage import settle

CELL = ["scene", "r", "c"]
#: Doubt of a coarse surface model in metres, least agreement and cells of a band fit, weights of mapped heights and control points.
DEM_DOUBT, BAND_R, BAND_CELLS, MAPPED_WEIGHT, POINT_WEIGHT = 5.0, 0.1, 64, 10.0, 20.0
#: The modes, by ground in metres and heights in metres.
MODES = {(True, True): "absolute", (True, False): "terrain_only", (False, True): "above_ground", (False, False): "relative"}


@dataclass
class Heights:
    cells: DataFrame  # scene, r, c, rel, unc, above, ndsm, dtm, dsm, sigma, confidence, building, tree, water, shadow, label, mode
    scenes: DataFrame  # scene, sun_source, scale, scale_source, unit, mode, anchors, inliers, rho, rmse
    anchors: DataFrame  # scene, source, label, row, col, rel, h, spread, w, k, inlier


def resolved(scenes: DataFrame) -> DataFrame:
    """Adds sun_elevation, sun_azimuth, sun_source, off_nadir and view_azimuth.

    Both sun angles come from the user, else both from the image's tags, else from the time and place of the image; of
    the view each angle comes from the user or the tags.  Columns: user_*, tag_* (sun_elevation, sun_azimuth, off_nadir,
    view_azimuth), acquired, lon, lat; any may be null."""
    pair = lambda el, az, name: F.struct(el.cast("double").alias("el"), az.cast("double").alias("az"), F.lit(name).alias("source"))
    both = lambda p, name: F.when(F.col(f"{p}_sun_elevation").isNotNull() & F.col(f"{p}_sun_azimuth").isNotNull(), pair(F.col(f"{p}_sun_elevation"), F.col(f"{p}_sun_azimuth"), name))
    known = F.col("acquired").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    computed = F.when(known, pair(*solar.sun_position(F.col("acquired"), F.col("lat"), F.col("lon")), "computed from acquisition time"))
    sun = F.coalesce(both("user", "entered by user"), both("tag", "image metadata"), computed)
    view = {n: F.coalesce(F.col(f"user_{n}"), F.col(f"tag_{n}")).cast("double") for n in ("off_nadir", "view_azimuth")}
    out = scenes.withColumn("sun", sun).withColumns({"sun_elevation": F.col("sun.el"), "sun_azimuth": F.col("sun.az"), "sun_source": F.col("sun.source")})
    return out.withColumns(view).drop("sun")


def scaled(scenes: DataFrame, anchors: DataFrame, bands: DataFrame, tallest: DataFrame) -> DataFrame:
    """scene, scale, scale_source, unit, inliers, anchors: metres for a unit of relative height.

    By the anchors (of ``statistics.inlier_anchors``: scene, source, k, w, inlier, n); else by the detail that the
    surface model itself shows (``bands``: scene, s, r, n), where it agrees; else by the user's height of the tallest
    buildings (scenes.prior_m over ``tallest``: scene, top); else there is none, and the unit is relative."""
    kept = anchors.where("inlier")
    fit = st.weighted_median(kept.select("scene", "k", "w"), ["scene"], "k", "w").withColumnRenamed("wmedian", "fit")
    told = kept.groupBy("scene").agg(F.count("*").alias("inliers"), F.max("n").alias("anchors"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    agreed = bands.where((F.col("n") >= BAND_CELLS) & (F.col("r") >= BAND_R) & (F.col("s") > 0)).select("scene", F.col("s").alias("band"))
    prior = F.when(F.col("top") > 0, F.col("prior_m") / F.col("top"))
    way = F.coalesce(
        F.when(F.col("fit").isNotNull(), F.struct(F.col("fit").alias("scale"), F.col("sources").alias("source"))),
        F.when(F.col("band").isNotNull(), F.struct(F.col("band").alias("scale"), F.lit("dem_band").alias("source"))),
        F.when(prior.isNotNull(), F.struct(prior.alias("scale"), F.lit("user prior").alias("source"))),
    )
    joined = scenes.select("scene", "prior_m").join(fit, "scene", "left").join(told, "scene", "left").join(agreed, "scene", "left").join(tallest, "scene", "left")
    unit = F.when(F.col("way").isNull(), "relative").otherwise("m")
    return joined.withColumn("way", way).select("scene", F.col("way.scale").alias("scale"), F.col("way.source").alias("scale_source"), unit.alias("unit"), F.coalesce("inliers", F.lit(0)).alias("inliers"), F.coalesce("anchors", F.lit(0)).alias("anchors"))


def agreement(anchors: DataFrame, scales: DataFrame) -> DataFrame:
    """scene, med, rho, rmse: how far relative heights follow all usable anchors, outliers included."""
    mean = anchors.groupBy("scene").agg(
        F.median("h").alias("med"), st.correlation("rel", "h").alias("r"), F.count("*").alias("n")
    )
    rho = F.when(F.col("n") >= 8, F.coalesce(F.greatest(F.lit(0.0), F.col("r")), F.lit(1.0))).otherwise(1.0)
    both = anchors.join(mean.select("scene", "med", rho.alias("rho")), "scene").join(scales.select("scene", "scale"), "scene")
    off = F.col("med") + F.col("rho") * (F.col("scale") * F.col("rel") - F.col("med")) - F.col("h")
    return both.groupBy("scene").agg(F.first("med").alias("med"), F.first("rho").alias("rho"), F.sqrt(F.avg(off * off)).alias("rmse"))


def fused(cells: DataFrame, scales: DataFrame, anchors: DataFrame, field: str | None = None) -> DataFrame:
    """Adds ``ndsm`` and ``doubt``: heights above ground, and their error.

    Buildings with a height of their own (mapped ones before measured ones) take it; others the model's, drawn towards the
    typical height as far as the model fails to follow the anchors; trees the model's; the rest is ground.  In a scene
    without scale both stay relative.  ``cells``: scene, r, c, above, unc, building, tree, label; ``field`` names a column
    of factors on the scale."""
    fit = agreement(anchors, scales)
    own = st.latest_wins(anchors.where("label IS NOT NULL AND source IN ('shadow', 'osm')").withColumn("mapped", (F.col("source") == "osm").cast("int")), ["scene", "label"], "mapped", "w")
    own = own.select("scene", "label", F.col("h").alias("own"), F.hypot(F.coalesce("spread", F.lit(1.0)), F.lit(1.0)).alias("own_doubt"))
    joined = cells.join(scales.select("scene", "scale"), "scene").join(fit, "scene", "left").join(own, ["scene", "label"], "left")
    factor = F.col("scale") * (F.coalesce(F.col(field), F.lit(1.0)) if field else F.lit(1.0))
    est = F.col("above") * factor
    drawn = F.greatest(F.lit(0.0), F.coalesce(F.col("med") + F.col("rho") * (est - F.col("med")), est))
    loose = F.greatest(2 * F.col("unc") * factor, 0.35 * est)
    ndsm = F.when(F.col("scale").isNull(), F.col("above")).when(F.col("building"), F.coalesce("own", drawn)).when(F.col("tree"), est).otherwise(0.0)
    doubt = (
        F.when(F.col("scale").isNull(), 2 * F.col("unc") + 0.02).when(F.col("building"), F.coalesce("own_doubt", "rmse", loose)).when(F.col("tree"), loose).otherwise(0.7)
    )
    return joined.withColumns({"ndsm": ndsm, "doubt": doubt}).select(*cells.columns, "ndsm", "doubt")


def assembled(cells: DataFrame, scales: DataFrame, dem: str, sigma: float, height: int, width: int, surface: bool = True) -> DataFrame:
    """Adds dtm, dsm, sigma, mode and confidence by what a scene has in metres: ground (``dem``), heights, both or neither.

    ``surface`` tells that the ground still holds buildings, blurred over ``sigma`` pixels, which are taken off first."""
    ground = F.col(dem).isNotNull()
    # Scenes with ground anywhere have it everywhere: gaps are filled before.
    with_ground = cells.where(ground).select("scene").distinct().withColumn("grounded", F.lit(True))
    joined = cells.join(scales.select("scene", "unit"), "scene").join(with_ground, "scene", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    if surface:
        blur = regrid.lowpass(joined.where(F.col("grounded") & (F.col("unit") == "m")), "ndsm", sigma, height, width).withColumnRenamed("ndsm", "blur")
        joined = joined.join(blur, CELL, "left")
    else:
        joined = joined.withColumn("blur", F.lit(0.0))
    limits = cal.quantile(cells, ["scene"], "unc", 0.6, "q60").join(cal.quantile(cells, ["scene"], "unc", 0.9, "q90"), "scene")
    metres = F.col("unit") == "m"
    mode = F.coalesce(*[F.when((F.col("grounded") == g) & (metres == m), F.lit(name)) for (g, m), name in MODES.items()])
    out = joined.join(limits, "scene").withColumn("mode", mode)
    by = lambda **ways: F.coalesce(*[F.when(F.col("mode") == m, v) for m, v in ways.items()])
    dtm = F.when(F.col("mode") == "absolute", F.col(dem) - F.coalesce("blur", F.lit(0.0))).when(F.col("mode") == "terrain_only", F.col(dem))
    out = out.withColumn("dtm", dtm)
    dsm = by(absolute=F.col("dtm") + F.col("ndsm"), terrain_only=F.col(dem), above_ground=F.col("ndsm"), relative=F.col("rel"))
    doubt = by(absolute=F.sqrt(F.col("doubt") * F.col("doubt") + DEM_DOUBT**2), terrain_only=F.lit(DEM_DOUBT), above_ground=F.col("doubt"), relative=F.col("doubt"))
    metric = rules.confidence(F.col("doubt"), F.col("ndsm"), F.col("shadow"), F.col("water"))
    relative = rules.relative_confidence(F.col("unc"), F.col("q60"), F.col("q90"), F.col("shadow"), F.col("water"))
    return out.withColumns({"dsm": dsm, "sigma": doubt, "confidence": F.when(metres, metric).otherwise(relative)}).select(*cells.columns, "dtm", "dsm", "sigma", "mode", "confidence")


def _dark(cells: DataFrame, height: int, width: int) -> DataFrame:
    """scene, r, c, dark: brightness, slightly blurred, under the lesser of Otsu's threshold and 0.6 of the median."""
    v = nb.gaussian(cells.select(*CELL, F.greatest("red", "green", "blue").cast("double").alias("v")), "v", 0.8, height, width)
    levels = nb.otsu(v.select("scene", F.floor("v").alias("v")), "v").join(cal.quantile(v, ["scene"], "v", 0.5, "med"), "scene")
    # An image of one brightness has no threshold, hence no shadow.
    return v.join(levels, "scene", "left").select(*CELL, F.coalesce(F.col("v") < F.least(F.col("threshold").cast("double"), 0.6 * F.col("med")), F.lit(False)).alias("dark"))


def _blue(cells: DataFrame, height: int, width: int) -> DataFrame:
    soft = cells.select(*CELL, "red", "green", "blue")
    for band in ("red", "green", "blue"):
        soft = nb.gaussian(soft, band, 1.1, height, width)
    return soft.select(*CELL, rules.water_colour(F.col("red"), F.col("green"), F.col("blue")).alias("blue_hue"))


def masks(pixels: DataFrame, scenes: DataFrame, height: int, width: int, window: int) -> DataFrame:
    """Adds above, water, shadow, veg, roof, high, building, tree and label (null outside buildings; mapped footprints,
    in column ``footprint``, keep their numbers)."""
    ground = cal.ground_surface(pixels.select(*CELL, "rel"), "rel", window, height, width).withColumnRenamed("rel", "ground")
    cells = settle(pixels.join(ground, CELL).withColumn("above", F.greatest(F.lit(0.0), F.col("rel") - F.col("ground"))), "above")
    limits = cal.quantile(cells, ["scene"], "above", 0.99, "p99").select("scene", F.greatest(F.lit(0.02), 0.2 * F.col("p99")).alias("limit"))
    area = F.col("gsd") * F.col("gsd")
    limits = settle(scenes.join(limits, "scene").select("scene", "limit", area.alias("pixel_m2")), "limits")
    bound = lambda m2, unknown, least: limits.select("scene", F.greatest(F.coalesce((m2 / F.col("pixel_m2")).cast("long"), F.lit(unknown)), F.lit(least)).alias("least"))
    raised = nb.extreme(cells.join(limits, "scene").withColumn("raised", F.col("above") > F.col("limit")).drop("limit", "pixel_m2"), "raised", 5)
    wet = cal.water_regions(raised.join(_blue(cells, height, width), CELL), "blue_hue", "raised", width, 3, bound(2000.0, 400, 50)).drop("blue_hue", "raised")
    wet = settle(wet, "water")
    shady = settle(cal.shadow_mask(wet.join(_dark(wet, height, width), CELL), "dark", "water", width).drop("dark"), "shadow")
    green = cal.vegetation(shady, height, width)
    roofed = roofs.roof_segments(green, limits, height, width, "above").withColumn("roof", F.col("roof") & ~F.col("water"))
    solid = settle(cal.object_masks(cal.elevated(roofed, "above", "water"), width, bound(20.0, 15, 6)), "objects")
    mapped = solid.where("footprint IS NOT NULL").select(*CELL, F.col("footprint").cast("long").alias("label"))
    found = graph.components(solid.withColumn("free", F.col("building") & F.col("footprint").isNull()), "free", width)
    rank = F.dense_rank().over(Window.partitionBy("scene").orderBy("first"))
    numbers = found.groupBy("scene", F.col("label").alias("first")).agg(F.count("*").alias("size")).select("scene", "first", rank.cast("long").alias("number"))
    detected = found.withColumnRenamed("label", "first").join(numbers, ["scene", "first"]).select(*CELL, F.col("number").alias("label"))
    labels = cal.merged_buildings(detected, mapped)
    out = solid.join(labels, CELL, "left").withColumns({"building": F.col("label").isNotNull(), "tree": F.col("tree") & F.col("footprint").isNull()})
    return settle(out, "masks")


def calibrate(
    pixels: DataFrame, scenes: DataFrame, height: int, width: int, window: int, dem_sigma: float, points: DataFrame | None = None, mapped: DataFrame | None = None, surface: bool = True,
) -> Heights:
    """Calibrated heights of all scenes.

    ``pixels``: scene, r, c, red, green, blue, rel, unc, dem, footprint (the last two may be null).  ``scenes``: scene,
    gsd, prior_m, dem_res and the columns of ``resolved``.  ``points``: scene, u, v, elevation of control points;
    ``mapped``: scene, label, h of footprints with a tagged height.  ``window`` is the width in cells of what counts as
    ground, ``dem_sigma`` the blur of the surface model in pixels."""
    known = settle(resolved(scenes), "scenes")
    cells = masks(pixels, known, height, width, window)
    # Ground: the model's heights, moved to the control points that stand on the ground.
    if points is not None:
        at = points.select("scene", *[F.greatest(F.lit(0), F.least(F.lit(n - 1), F.bround(F.col(x) * (n - 1)))).cast("long").alias(a) for a, x, n in (("r", "v", height), ("c", "u", width))], "elevation")
        limit = cal.quantile(cells, ["scene"], "above", 0.99, "p99").select("scene", F.greatest(F.lit(0.02), 0.2 * F.col("p99")).alias("limit"))
        at = settle(at.join(cells.select(*CELL, "above", "dem"), CELL).join(limit, "scene").withColumn("ground", F.col("above") <= F.col("limit")), "points")
        bias = cal.dem_bias(at, ["scene"], "elevation", "dem", "ground").select("scene", "bias")
        cells = cells.join(bias, "scene", "left").withColumn("dem", F.col("dem") + F.coalesce("bias", F.lit(0.0))).drop("bias")
        # Scenes without a model but with ground points and a pixel size: a plane through these, or their mean.
        free = at.where("ground AND dem IS NULL").join(known.where("gsd IS NOT NULL").select("scene"), "scene", "left_semi")
        flat = st.plane(free.select("scene", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "elevation"), ["scene"], "x", "y", "elevation")
        few = free.groupBy("scene").agg(F.count("*").alias("n"), F.avg("elevation").alias("mean"))
        laid = F.when(F.col("n") >= 3, F.col("p0") + F.col("p1") * F.col("c") + F.col("p2") * F.col("r")).otherwise(F.col("mean"))
        cells = cells.join(flat.join(few, "scene"), "scene", "left").withColumn("dem", F.coalesce("dem", laid)).drop("p0", "p1", "p2", "n", "mean")
    sun = known.select("scene", "gsd", "sun_elevation", "sun_azimuth", "off_nadir", "view_azimuth")
    smooth = nb.gradient(nb.gaussian(cells.where("dem IS NOT NULL").select(*CELL, "dem"), "dem", 3.0, height, width), "dem").select(*CELL, "gr", "gc")
    rise = (F.col("gr") * F.cos(F.radians("sun_azimuth")) - F.col("gc") * F.sin(F.radians("sun_azimuth"))) / F.col("gsd")
    cells = settle(cells.join(sun, "scene").join(smooth, CELL, "left").withColumn("rise", rise).drop("gr", "gc"), "ground")

    measured = cal.shadow_anchors(cells, "label", "shadow", "above", "gsd", "sun_elevation", "sun_azimuth", along="rise", off_nadir="off_nadir", view_azimuth="view_azimuth")
    anchors = st.clean_anchors(measured, ["scene"]).select("scene", F.lit("shadow").alias("source"), "label", "row", "col", "rel", "h", "spread", "w")
    if mapped is not None:
        body = cells.where("footprint IS NOT NULL").groupBy("scene", F.col("footprint").cast("long").alias("label")).agg(F.avg("r").alias("row"), F.avg("c").alias("col"), F.percentile("above", F.lit(0.75)).alias("rel"))
        tagged = mapped.where("h > 0").join(body, ["scene", "label"])
        anchors = anchors.unionByName(tagged.select("scene", F.lit("osm").alias("source"), "label", "row", "col", "rel", "h", F.lit(1.5).alias("spread"), F.lit(MAPPED_WEIGHT).alias("w")))
    if points is not None:
        # On a surface model a point stands above blurred buildings, so it is held against the detail of the same band.
        low = regrid.lowpass(cells, "above", dem_sigma, height, width).withColumnRenamed("above", "low") if surface else cells.select(*CELL, F.lit(0.0).alias("low"))
        high = at.where("NOT ground").select(*CELL, "elevation").join(cells.select(*CELL, "above", "dem"), CELL).join(low, CELL).where("dem IS NOT NULL")
        anchors = anchors.unionByName(
            high.select("scene", F.lit("gcp").alias("source"), F.lit(None).cast("long").alias("label"), F.col("r").cast("double").alias("row"), F.col("c").cast("double").alias("col"),
                        (F.col("above") - F.col("low")).alias("rel"), (F.col("elevation") - F.col("dem")).alias("h"), F.lit(None).cast("double").alias("spread"), F.lit(POINT_WEIGHT).alias("w"))
        )
    flagged = settle(st.inlier_anchors(anchors, ["scene"]), "anchors")

    block = max(1, round(dem_sigma))
    detail = []
    for value in ("rel", "dem"):
        mean = nb.block_mean(cells.where("dem IS NOT NULL AND gsd IS NOT NULL").select(*CELL, value), value, block, height, width)
        wide = nb.gaussian(mean, value, 4.0, height // block, width // block).withColumnRenamed(value, "wide")
        detail.append(mean.join(wide, CELL).select(*CELL, (F.col(value) - F.col("wide")).alias(value)))
    bands = st.band_scale(detail[0].join(detail[1], CELL), ["scene"], "rel", "dem")
    top = cal.quantile(cells.where("building"), ["scene"], "above", 0.99, "top_of_buildings").join(cal.quantile(cells, ["scene"], "above", 0.99, "top_of_all"), "scene", "right")
    scales = settle(scaled(known, flagged, bands, top.select("scene", F.coalesce("top_of_buildings", "top_of_all").alias("top"))), "scales")

    nodes = st.kernel_field(flagged.where("inlier").join(scales.select("scene", "scale"), "scene"), ["scene"], height, width)
    rows, cols = max(2, height // 32), max(2, width // 32)
    spread = regrid.regridded(nodes.select("scene", F.col("i").alias("r"), F.col("j").alias("c"), "factor"), "factor", height, width, regrid.stretch(rows, height), regrid.stretch(cols, width), "cubic")
    held = fused(cells.join(spread, CELL, "left"), scales, flagged, "factor")
    out = settle(assembled(settle(held, "fused"), scales, "dem", dem_sigma, height, width, surface), "heights")
    report = known.select("scene", "sun_source").join(scales, "scene").join(agreement(flagged, scales).select("scene", "rho", "rmse"), "scene", "left")
    return Heights(out, report.join(out.select("scene", "mode").distinct(), "scene"), flagged)
