"""The ground of scenes from elevation files: brought onto the scene's grid, laid over one another, moved to sea level,
filled and softened, for any number of scenes and files in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terrain as rules
from ..operators import calibration as cal
from ..operators import neighbours as nb
from ..operators import regrid
from ..sources.readers import mosaic
from ..storage import settle

CELL = ["scene", "r", "c"]


def laid(layers: DataFrame, height: int, width: int, kernel: str = "linear") -> DataFrame:
    """scene, r, c, z: files of other geometry on the scenes' grid; where they overlap the first file wins.

    ``layers``: scene, file (its order), r, c, z, and of the file's grid step_r, start_r, step_c, start_c (as in
    ``regrid.regridded``), rows, cols."""
    own = layers.withColumn("scene", F.struct("scene", "file"))
    placed = regrid.regridded(own, "z", height, width, ("step_r", "start_r"), ("step_c", "start_c"), kernel, ("rows", "cols"))
    return mosaic(placed.select(F.col("scene.scene").alias("scene"), "r", "c", F.col("scene.file").alias("file"), "z"), "file", "z")


def sea_level(heights: DataFrame, scenes: DataFrame, height: int, width: int, geoid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Heights at sea level, and scene, source, datum.

    The user's offset counts before all; sources over the ellipsoid lose the geoid's height, by its grid where that
    covers the whole scene, else by the file's tag, else as measured against another model.  ``scenes``: scene, path, tag,
    manual, tagged, measured; ``geoid``: scene, r, c, n on the scene's grid."""
    named = scenes.withColumn("source", rules.dem_source(F.col("path"), F.col("tag")))
    joined = heights.join(named.select("scene", "source", "manual", "tagged", "measured"), "scene")
    if geoid is None:
        joined = joined.withColumn("n", F.lit(None).cast("double"))
    else:
        whole = geoid.where("n IS NOT NULL AND NOT isnan(n)").groupBy("scene").agg(F.count("*").alias("k")).where(F.col("k") == height * width).select("scene")
        joined = joined.join(geoid.join(whole, "scene", "left_semi").select(*CELL, F.col("n").cast("double").alias("n")), CELL, "left")
    shift = rules.datum_shift(F.col("source"), F.col("manual"), F.col("n"), F.col("tagged"), F.col("measured"))
    moved = joined.select(*CELL, (F.col("z") + shift).alias("z"))
    return moved, named.select("scene", "source", rules.datum(F.col("source")).alias("datum"))


def ground_model(layers: DataFrame, scenes: DataFrame, height: int, width: int, blur: float, geoid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """scene, r, c, z over the whole grid of every scene that its files reach, and scene, source, datum.

    Gaps take the nearest height; ``blur`` (in cells, two fifths of a file's cell) hides the facets of coarse files.
    Scenes that no file reaches have no ground, hence no row."""
    found, told = sea_level(settle(laid(layers, height, width), "laid"), scenes, height, width, geoid)
    found = settle(found, "sea-level")
    places = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = found.select("scene").distinct().withColumn("r", places(height)).withColumn("c", places(width))
    filled = settle(cal.filled_gaps(grid.join(found, CELL, "left"), "z", width), "filled")
    soft = nb.gaussian(filled, "z", blur, height, width) if blur > 0 else filled
    return soft, told.join(found.select("scene").distinct(), "scene", "left_semi")
