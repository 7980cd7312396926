"""From an image and relative heights to masks, ground, and heights told by shadows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terrain as rules
from ..storage import settle
from . import distance, graph, regrid
from . import neighbours as nb

CELL = ["scene", "r", "c"]


def quantile(rows: DataFrame, by: list[str], value: str | Column, q: float, name: str = "q") -> DataFrame:
    """by, name: the exact quantile of each group, between two values in proportion.

    Equal values fold first; ranks then come from running counts in a sort that can spill, so no task keeps a group's
    values in memory, as an aggregate function would."""
    v = F.col(value) if isinstance(value, str) else value
    folded = rows.select(*by, v.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy(*by, "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    ranked = folded.select(*by, "v", F.sum("n").over(whole.orderBy("v")).alias("upto"), (q * (F.sum("n").over(whole) - 1)).alias("place"))
    low, high = (F.min(F.when(F.col("upto") > f("place"), F.col("v"))) for f in (F.floor, F.ceil))
    part = F.max("place") - F.floor(F.max("place"))
    return ranked.groupBy(*by).agg((low + (high - low) * part).alias(name))


def vegetation(cells: DataFrame, height: int, width: int, red: str = "red", green: str = "green", blue: str = "blue") -> DataFrame:
    """Adds ``veg``: green cells whose brightness varies around them, as leaves do and painted roofs do not."""
    grey = cells.select(*CELL, ((F.col(red) + F.col(green) + F.col(blue)) / 3.0).alias("grey"))
    rough = nb.local_std(grey, "grey", 5, height, width)
    green_enough = rules.excess_green(F.col(red), F.col(green), F.col(blue)) > 0.06
    return cells.join(rough, CELL).withColumn("veg", green_enough & (F.col("std") > 5)).drop("std")


def elevated(cells: DataFrame, value: str, water: str) -> DataFrame:
    """Adds ``high``: cells over a fifth of the scene's 99th percentile (0.02 at least) and not water, opened 3 x 3."""
    limit = quantile(cells, ["scene"], value, 0.99, "p99")  # one row per scene
    over = (F.col(value) > F.greatest(F.lit(0.02), 0.2 * F.col("p99"))) & ~F.col(water)
    return nb.opened(cells.join(limit, "scene").withColumn("high", F.coalesce(over, F.lit(False))).drop("p99"), "high", 3)


def _large(labels: DataFrame, least: int | DataFrame) -> DataFrame:
    """scene, label of the patches of ``least`` cells or more; a table (scene, least) bounds each scene by its own."""
    sizes = labels.groupBy("scene", "label").agg(F.count("*").alias("n"))
    bounded = sizes.join(least.select("scene", "least"), "scene") if isinstance(least, DataFrame) else sizes.withColumn("least", F.lit(least))
    return bounded.where(F.col("n") >= F.col("least")).select("scene", "label")


def object_masks(cells: DataFrame, width: int, least: int | DataFrame, high: str = "high", veg: str = "veg", roof: str = "roof") -> DataFrame:
    """Adds ``building`` (patches of ``least`` cells or more of what is high and not green, or a roof) and ``tree``."""
    marked = cells.withColumn("solid", (F.col(high) & ~F.col(veg)) | F.col(roof)).withColumn("tree", F.col(high) & F.col(veg) & ~F.col(roof))
    labels = graph.components(marked, "solid", width)
    kept = labels.join(_large(labels, least), ["scene", "label"], "left_semi").select(*CELL, F.lit(True).alias("building"))
    return marked.join(kept, CELL, "left").withColumn("building", F.coalesce("building", F.lit(False))).drop("solid")


def shadow_mask(cells: DataFrame, dark: str, water: str, width: int, least: int = 4) -> DataFrame:
    """Adds ``shadow``: dark cells that are not water, opened 2 x 2 (which moves it a cell down and right), in
    patches of ``least`` cells or more."""
    kept = nb.opened(cells.select(*CELL, (F.col(dark) & ~F.col(water)).alias("shadow")), "shadow", 2)
    labels = graph.components(kept, "shadow", width)
    large = labels.groupBy("scene", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("scene", "label")
    found = labels.join(large, ["scene", "label"], "left_semi").select(*CELL, F.lit(True).alias("shadow"))
    return cells.join(found, CELL, "left").withColumn("shadow", F.coalesce("shadow", F.lit(False)))


def water_regions(cells: DataFrame, blue: str, raised: str, width: int, k: int = 3, least: int | DataFrame = 400) -> DataFrame:
    """Adds ``water``: closed and opened patches of ``least`` cells or more, of which less than 0.6 is raised."""
    smooth = nb.opened(nb.closed(cells.select(*CELL, F.col(blue).alias("m"), raised), "m", k), "m", k)
    labels = graph.components(smooth, "m", width).join(smooth.select(*CELL, raised), CELL)
    share = F.avg(F.col(raised).cast("double"))
    flat = labels.groupBy("scene", "label").agg(share.alias("share")).where(F.col("share") < 0.6).join(_large(labels, least), ["scene", "label"], "left_semi")
    found = labels.join(flat.select("scene", "label"), ["scene", "label"], "left_semi").select(*CELL, F.lit(True).alias("water"))
    return cells.join(found, CELL, "left").withColumn("water", F.coalesce("water", F.lit(False)))


def ground_surface(cells: DataFrame, value: str, k: int, height: int, width: int) -> DataFrame:
    """``value`` without what is narrower than k cells: smoothed, opened (in place, for any k) and smoothed again."""
    low = nb.extreme(nb.gaussian(cells, value, 1.0, height, width), value, k, largest=False)
    return nb.gaussian(nb.extreme(low, value, k, ahead=True), value, k / 3, height, width)


def bare_earth(cells: DataFrame, value: str, under: str, height: int, width: int, sigma: float = 2.0) -> DataFrame:
    """``value`` under ``under`` (buildings) filled from the ground around: means by Gaussian weights, twice as wide
    each time until every cell has some, up to the scene's longer side; a scene without ground takes its median.

    Every width is written before the next; wide ones work on block means."""
    base = settle(cells.select(*CELL, F.when(F.col(under), 0.0).otherwise(F.col(value).cast("double")).alias("num"), (~F.col(under)).cast("double").alias("den")), "ground")
    ground = base.select(*CELL, F.when(F.col("den") > 0, F.col("num")).alias("ground"))
    while sigma < max(height, width):
        if sigma <= regrid.WIDEST:
            wide = nb.gaussian(nb.gaussian(base, "num", sigma, height, width), "den", sigma, height, width)
        else:
            wide = regrid.lowpass(base, "num", sigma, height, width).join(regrid.lowpass(base, "den", sigma, height, width), CELL)
        told = F.coalesce("ground", F.when(F.col("den") > 1e-3, F.col("num") / F.col("den")))
        ground = settle(ground.join(wide, CELL).select(*CELL, told.alias("ground")), "ground")
        if not ground.where("ground IS NULL").limit(1).count():
            break
        sigma *= 2
    middle = quantile(cells, ["scene"], value, 0.5, "middle")
    out = cells.join(ground, CELL).join(middle, "scene")
    return out.withColumn(value, F.when(F.col(under), F.coalesce("ground", "middle")).otherwise(F.col(value).cast("double"))).drop("ground", "middle")


def filled_gaps(cells: DataFrame, value: str, width: int) -> DataFrame:
    """``value``, where it is null or no number, from the nearest cell that has one; 0 in a scene without any."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    marked = cells.withColumn("known", known)
    near = distance.nearest(marked, "known", width).select(*CELL, "source")
    donors = marked.where("known").select("scene", (F.col("r") * width + F.col("c")).alias("source"), F.col(value).alias("lent"))
    gaps = marked.where("NOT known").select(*CELL).join(near, CELL).join(donors, ["scene", "source"], "left").select(*CELL, "lent")
    return cells.join(gaps, CELL, "left").withColumn(value, F.when(known, F.col(value)).otherwise(F.coalesce("lent", F.lit(0)))).drop("lent")


Number = float | str  # or the name of a column that is the same in all cells of a scene


def _number(x: Number) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def shadow_walk(cells: DataFrame, label: str, shadow: str, azimuth: Number, most: Number, keep: tuple[str, ...] = ()) -> DataFrame:
    """scene, r, c, label, length, valid for each building cell at whose edge a shadow begins.

    A ray leaves the sun for ``most`` steps at most; ``length`` is how many of them stay in shadow, and ``valid`` tells
    that it then meets open ground, not a building nor the image's edge.  ``label`` is null outside buildings.  Columns of
    a scene named in ``keep`` come along; a scene without azimuth or steps has no ray.
    """
    if isinstance(azimuth, str):
        dr, dc = F.cos(F.radians(azimuth)), -F.sin(F.radians(azimuth))
    else:
        dr, dc = F.lit(math.cos(math.radians(azimuth))), F.lit(-math.sin(math.radians(azimuth)))
    steps = _number(most).cast("int")
    keep = tuple(dict.fromkeys([*keep, *[x for x in (azimuth, most) if isinstance(x, str)]]))
    ahead = cells.select("scene", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col(label).alias("other"), F.col(shadow).alias("dark"))

    def moved(rows: DataFrame, t: Column) -> DataFrame:
        return rows.withColumns({"nr": F.rint(F.col("r") + t * dr).cast("long"), "nc": F.rint(F.col("c") + t * dc).cast("long")})

    inside = cells.where(F.col(label).isNotNull() & (steps >= 1) & dr.isNotNull()).select(*CELL, F.col(label).alias("label"), *keep)
    edge = moved(inside, F.lit(1)).join(ahead, ["scene", "nr", "nc"]).where(F.col("dark") & ~F.col("other").eqNullSafe(F.col("label"))).select(*CELL, "label", *keep)
    rays = moved(edge.withColumn("t", F.explode(F.sequence(F.lit(1), steps))), F.col("t")).join(ahead, ["scene", "nr", "nc"], "left")
    stop = F.when(~F.coalesce("dark", F.lit(False)), F.struct("t", (F.col("dark").isNotNull() & F.col("other").isNull()).alias("clean")))
    ended = rays.groupBy(*CELL, "label", *keep).agg(F.min(stop).alias("stop"))
    length = (F.coalesce(F.col("stop.t"), steps + 1) - 1).cast("long")
    return ended.select(*CELL, "label", *keep, length.alias("length"), F.coalesce(F.col("stop.clean"), F.lit(False)).alias("valid"))


def shadow_anchors(
    cells: DataFrame, label: str, shadow: str, value: str, gsd: Number, elevation: Number, azimuth: Number, longest: float = 150.0, along: str | None = None,
    off_nadir: Number = 0.0, view_azimuth: Number = 0.0, lowest_sun: float = 10.0,
) -> DataFrame:
    """scene, label, row, col, rel, h, spread, w: heights of buildings by the upper quartile of their shadows' lengths
    (three valid rays at least).  ``along`` is the ground's rise along the shadow, where terrain is known.  Sun, view and
    pixel size are numbers or columns of the scenes; scenes whose sun stands under ``lowest_sun`` degrees, or whose sun or
    pixel size is unknown, have no anchor."""
    named = tuple(dict.fromkeys(x for x in (gsd, elevation, azimuth, off_nadir, view_azimuth) if isinstance(x, str)))
    steps = F.when(_number(elevation) >= lowest_sun, F.floor(longest / _number(gsd)))
    rays = shadow_walk(cells.withColumn("ray_steps", steps), label, shadow, azimuth, "ray_steps", named).where("valid")
    rise = F.lit(0.0)
    if along is not None:
        rays, rise = rays.join(cells.select(*CELL, F.col(along).alias("rise")), CELL), F.coalesce(F.median("rise"), F.lit(0.0))
    # Groups are the edges of single buildings, hence small.
    told = rays.groupBy("scene", "label", *named).agg(F.count("*").alias("n"), F.percentile("length", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), rise.alias("rise")).where("n >= 3")
    pixels = F.col("q")[1] + 0.5
    lean, turn = F.coalesce(_number(off_nadir), F.lit(0.0)), F.coalesce(_number(view_azimuth) - _number(azimuth), F.lit(90.0))  # an unknown view leans nowhere along the shadow
    h = rules.shadow_height(pixels, _number(gsd), _number(elevation), F.col("rise"), lean, turn)
    told = told.select("scene", "label", h.alias("h"), (F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1.0)) / pixels).alias("share"), F.least("n", F.lit(20)).cast("double").alias("w")).where("h IS NOT NULL")
    body = cells.where(F.col(label).isNotNull()).groupBy("scene", F.col(label).alias("label")).agg(
        F.avg("r").alias("row"), F.avg("c").alias("col"), F.percentile(value, F.lit(0.75)).alias("rel")
    ).where("rel > 0.005")
    return told.join(body, ["scene", "label"]).select("scene", "label", "row", "col", "rel", "h", (F.col("share") * F.col("h")).alias("spread"), "w")


def merged_buildings(detected: DataFrame, mapped: DataFrame) -> DataFrame:
    """scene, r, c, label: mapped buildings win; detected ones are numbered after the scene's last mapped one."""
    last = mapped.groupBy("scene").agg(F.max("label").alias("last"))
    found = detected.select(*CELL, F.col("label").alias("found")).join(last, "scene", "left")
    both = found.join(mapped.select(*CELL, F.col("label").alias("own")), CELL, "full")
    return both.select(*CELL, F.coalesce("own", F.col("found") + F.coalesce("last", F.lit(0))).alias("label"))


def dem_bias(points: DataFrame, by: list[str], elevation: str, dem: str, ground: str) -> DataFrame:
    """by, bias, n: the median of measured less modelled elevation over points on the ground."""
    off = points.where(F.col(ground)).select(*by, (F.col(elevation) - F.col(dem)).alias("off")).where("off IS NOT NULL")
    return quantile(off, by, "off", 0.5, "bias").join(off.groupBy(*by).agg(F.count("*").alias("n")), by)


def profile(cells: DataFrame, values: list[str], segments: DataFrame, height: int, width: int, points: int = 200, cell: float = 1.0) -> DataFrame:
    """scene, segment, k, distance and ``values`` at even steps along segments (scene, segment, u0, v0, u1, v1), whose
    ends are shares of the width and height."""
    k = F.col("k")
    at = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    place = lambda a, b, n: F.least(F.greatest(((F.col(a) + k * ((F.col(b) - F.col(a)) / (points - 1))) * n).cast("long"), F.lit(0)), F.lit(n - 1))
    length = F.hypot((F.col("u1") - F.col("u0")) * width, (F.col("v1") - F.col("v0")) * height) * cell
    at = at.select("scene", "segment", "k", place("v0", "v1", height).alias("r"), place("u0", "u1", width).alias("c"), F.round(k * (length / (points - 1)), 2).alias("distance"))
    return at.join(cells.select(*CELL, *values), CELL).select("scene", "segment", "k", "distance", *values)
