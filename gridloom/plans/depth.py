"""Relative heights from an image: a model over views and tiles, aligned to one another and blended.

A model is a function from cells (scene, r, c, bands) and their size to (scene, r, c, value).  Views and tiles of all
scenes are scenes of their own to it, so one run of the model serves them all, and one aggregation fits them all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import neighbours as nb
from ..operators import regrid
from ..operators import statistics as st
from ..storage import settle

CELL = ["scene", "r", "c"]
Model = Callable[[DataFrame, int, int], DataFrame]


def ellipse(k: int) -> list[tuple[int, int]]:
    """(rows off the middle, half the width there) of an ellipse in a square of k x k cells, k odd."""
    half = k // 2
    return [(d, round(half * math.sqrt(max(0.0, half * half - d * d)) / half) if half else 0) for d in range(-half, half + 1)]


def elliptic(cells: DataFrame, value: str, k: int, largest: bool) -> DataFrame:
    """Largest or smallest over an ellipse: each of its rows is a window of its own width, moved to its place; what lies
    beyond the border does not count."""
    pick, both = (F.max, F.greatest) if largest else (F.min, F.least)
    rows = ellipse(k)
    widths = sorted({w for _, w in rows})
    lines = cells.select("*", *[pick(value).over(nb.framed("c", w, w)).alias(f"over@{w}") for w in widths])
    parts = [F.col(f"`over@{w}`") if d == 0 else F.lag(f"`over@{w}`", -d).over(nb.along("r")) for d, w in rows]
    return lines.withColumn(value, both(*parts) if len(parts) > 1 else parts[0]).drop(*[f"over@{w}" for w in widths])


def top_hat(cells: DataFrame, value: str, k: int) -> DataFrame:
    """scene, r, c, ``value``: what stands over its surroundings and is narrower than the ellipse."""
    kept = cells.select(*CELL, value, F.col(value).alias("whole"))
    low = elliptic(elliptic(kept, value, k, largest=False), value, k, largest=True)
    return low.select(*CELL, (F.col("whole") - F.col(value)).alias(value))


def bright_blobs(cells: DataFrame, height: int, width: int) -> DataFrame:
    """A stand-in for a model: bright, compact, raised spots on a broad glow.  scene, r, c, value."""
    grey = (0.299 * F.col("red") + 0.587 * F.col("green") + 0.114 * F.col("blue")) / 255.0
    soft = settle(nb.gaussian(cells.select(*CELL, grey.alias("value")), "value", 1.5, height, width), "grey")
    hats = settle(top_hat(soft, "value", max(9, (min(height, width) // 40) | 1)), "hats")
    most = hats.groupBy("scene").agg(F.max("value").alias("most"))  # a row per scene
    broad = regrid.lowpass(soft, "value", min(height, width) / 15, height, width).withColumnRenamed("value", "broad")
    return hats.join(most, "scene").join(broad, CELL).select(*CELL, (0.7 * F.col("value") / (F.col("most") + 1e-6) + 0.3 * F.col("broad")).alias("value"))


def turned(view: Column, r: Column, c: Column, height: int, width: int, back: bool = False) -> tuple[Column, Column]:
    """Row and column of a cell in view 0 (as it is), 1 (left and right exchanged), 2 (top and bottom exchanged) or 3 (a
    quarter turn against the clock), or the way ``back``."""
    row = F.when(view == 2, height - 1 - r).when(view == 3, c if back else width - 1 - c).otherwise(r)
    col = F.when(view == 1, width - 1 - c).when(view == 3, width - 1 - r if back else r).otherwise(c)
    return row, col


def _aligned(rows: DataFrame, by: list[str], trim: float = 0.05) -> DataFrame:
    """Adds ``fitted``: ``value`` brought to ``ref`` by a trimmed affine fit per group; a slope that is not positive
    gives way to the ratio of the deviations, so no tile is turned over."""
    fit = st.trimmed_affine(rows, by, "value", "ref", trim)
    level = rows.groupBy(*by).agg(F.avg("value").alias("mv"), F.avg("ref").alias("mr"), F.stddev_pop("value").alias("sv"), F.stddev_pop("ref").alias("sr"))
    both = fit.join(level, by)
    ratio = (F.col("sr") + 1e-6) / (F.col("sv") + 1e-6)
    flipped = (F.col("a") <= 0) & (F.col("sv") > 1e-9)
    a, b = F.when(flipped, ratio).otherwise(F.col("a")), F.when(flipped, F.col("mr") - ratio * F.col("mv")).otherwise(F.col("b"))
    return rows.join(both.select(*by, a.alias("a"), b.alias("b")), by).withColumn("fitted", F.col("a") * F.col("value") + F.col("b")).drop("a", "b")


def viewed(cells: DataFrame, model: Model, height: int, width: int) -> DataFrame:
    """scene, r, c, value, unc: mean and spread of the model over four views, each brought to the first."""
    bands = [x for x in cells.columns if x not in CELL]
    views = cells.withColumn("view", F.explode(F.array(*map(F.lit, range(4)))))
    row, col = turned(F.col("view"), F.col("r"), F.col("c"), height, width)
    seen = views.select(F.struct("scene", "view").alias("scene"), row.alias("r"), col.alias("c"), *bands)
    upright = model(seen.where("scene.view < 3"), height, width)
    lying = model(seen.where("scene.view = 3"), width, height)
    told = upright.select(*CELL, "value").unionByName(lying.select(*CELL, "value"))
    row, col = turned(F.col("scene.view"), F.col("r"), F.col("c"), height, width, back=True)
    mapped = settle(told.select(F.col("scene.scene").alias("scene"), F.col("scene.view").alias("view"), row.alias("r"), col.alias("c"), "value"), "views")
    first = mapped.where("view = 0").select(*CELL, F.col("value").alias("ref"))
    others = _aligned(mapped.where("view > 0").join(first, CELL), ["scene", "view"])
    every = others.select(*CELL, F.col("fitted").alias("value")).unionByName(first.withColumnRenamed("ref", "value"))
    return every.groupBy(*CELL).agg(F.avg("value").alias("value"), F.stddev_pop("value").alias("unc"))


def relative_heights(cells: DataFrame, model: Model, height: int, width: int, tile: int = 518, overlap: float = 0.5, views: bool = True) -> DataFrame:
    """scene, r, c, rel (0 to 1) and unc: a pass over the whole image, then tiles at full resolution, each brought to
    that pass by a trimmed affine fit and blended; images little larger than a tile have none."""
    if views:
        whole = viewed(cells, model, height, width)
    else:
        whole = model(cells, height, width).select(*CELL, "value", F.lit(0.0).alias("unc"))
    whole = settle(whole, "whole")
    found = whole
    if max(height, width) > tile * 1.25:
        bands = [x for x in cells.columns if x not in CELL]
        tall, wide = min(tile, height), min(tile, width)
        cut = nb.tiled(cells, tile, max(1, int(tile * (1 - overlap))), height, width)
        inner = cut.select(F.struct("scene", "tr", "tc").alias("scene"), (F.col("r") - F.col("tr")).alias("r"), (F.col("c") - F.col("tc")).alias("c"), *bands)
        told = settle(model(inner, tall, wide).select(F.col("scene.scene").alias("scene"), F.col("scene.tr").alias("tr"), F.col("scene.tc").alias("tc"), (F.col("r") + F.col("scene.tr")).alias("r"), (F.col("c") + F.col("scene.tc")).alias("c"), "value"), "tiles")
        fitted = _aligned(told.join(whole.select(*CELL, F.col("value").alias("ref")), CELL), ["scene", "tr", "tc"])
        weights = cut.select(*CELL, "tr", "tc", "w")
        blend = nb.blended(fitted.select(*CELL, "tr", "tc", "fitted").join(weights, [*CELL, "tr", "tc"]), "fitted").withColumnRenamed("fitted", "value")
        found = settle(blend.join(whole.select(*CELL, "unc"), CELL), "blend")
    ends = cal.quantile(found, ["scene"], "value", 0.005, "lo").join(cal.quantile(found, ["scene"], "value", 0.995, "hi"), "scene")
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("lo")) / span))
    return found.join(ends, "scene").select(*CELL, rel.alias("rel"), (F.col("unc") / span).alias("unc"))
