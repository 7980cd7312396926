"""Whole roofs as patches of one colour between edges, in a colour space that is even to the eye."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from . import graph
from . import neighbours as nb
from .calibration import CELL, quantile

#: The steepest colour step and the greatest roughness of a uniform patch, and a roof's size in square metres.
STEP, ROUGHNESS, ROOF_M2 = 60.0, 6.0, (20.0, 2000.0)


def _beside(value: str, direction: str) -> tuple[Column, Column]:
    """The values before and after along a line; at the border the other side's stands in, as in a mirror."""
    back, ahead = F.lag(value).over(nb.along(direction)), F.lead(value).over(nb.along(direction))
    return F.coalesce(back, ahead, F.col(value)), F.coalesce(ahead, back, F.col(value))


def colour_steps(cells: DataFrame, values: list[str]) -> DataFrame:
    """scene, r, c, step: the lengths of the 3 x 3 Sobel gradients of ``values``, summed."""
    along = {}
    for v in values:
        back, ahead = _beside(v, "c")
        along |= {f"{v}_d": ahead - back, f"{v}_s": back + 2 * F.col(v) + ahead}
    lines = cells.select(*CELL, *[e.alias(n) for n, e in along.items()])
    lengths = []
    for v in values:
        (d_back, d_ahead), (s_back, s_ahead) = _beside(f"{v}_d", "r"), _beside(f"{v}_s", "r")
        lengths.append(F.hypot((d_back + 2 * F.col(f"{v}_d") + d_ahead).cast("double"), (s_ahead - s_back).cast("double")))
    return lines.select(*CELL, sum(lengths[1:], lengths[0]).alias("step"))


def uniform_patches(cells: DataFrame, shadow: str, height: int, width: int, red: str = "red", green: str = "green", blue: str = "blue") -> DataFrame:
    """scene, r, c, label: four-connected patches of even colour and brightness outside shadows, opened 3 x 3."""
    lightness, a, b = colour.lab(F.col(red), F.col(green), F.col(blue))
    steps = colour_steps(cells.select(*CELL, lightness.alias("l"), a.alias("a"), b.alias("b")), ["l", "a", "b"])
    grey = cells.select(*CELL, ((F.col(red) + F.col(green) + F.col(blue)) / 3.0).alias("grey"))
    rough = nb.local_std(grey, "grey", 5, height, width)
    even = (F.col("step") < STEP) & (F.col("std") < ROUGHNESS) & ~F.col(shadow)
    marked = cells.select(*CELL, shadow).join(steps, CELL).join(rough, CELL).select(*CELL, even.alias("even"))
    return graph.components(nb.opened(marked, "even", 3), "even", width, diagonal=False)


def roof_segments(cells: DataFrame, limits: DataFrame, height: int, width: int, value: str = "rel", shadow: str = "shadow", **colours: str) -> DataFrame:
    """Adds ``roof``: patches of a roof's size whose middle relative height is over half the limit of raised cells, grown by
    a cell on all sides.  ``limits`` (scene, limit, pixel_m2) has a row per scene; an unknown pixel size counts as a
    quarter of a square metre.  A scene without limits has no roof."""
    patches = uniform_patches(cells, shadow, height, width, **colours)
    held = patches.join(cells.select(*CELL, value), CELL)
    sizes = held.groupBy("scene", "label").agg(F.count("*").alias("n"))
    middle = quantile(held, ["scene", "label"], value, 0.5, "middle")
    area = F.col("n") * F.coalesce("pixel_m2", F.lit(0.25))
    raised = F.col("middle") > 0.5 * F.col("limit")
    kept = sizes.join(middle, ["scene", "label"]).join(limits, "scene").where((area >= ROOF_M2[0]) & (area <= ROOF_M2[1]) & raised)
    found = patches.join(kept.select("scene", "label"), ["scene", "label"], "left_semi").select(*CELL, F.lit(True).alias("roof"))
    return nb.extreme(cells.join(found, CELL, "left").withColumn("roof", F.coalesce("roof", F.lit(False))), "roof", 3)
