"""Control points from CSV, footprints from GeoJSON, tags of imagery, saved scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

#: Names under which image files state the sun and the view, the first that is present counts.
SUN_ELEVATION = ("SUN_ELEVATION", "SUNELEVATION", "SUN_ELEV", "SOLAR_ELEVATION")
SUN_AZIMUTH = ("SUN_AZIMUTH", "SUNAZIMUTH", "SUN_AZ", "SOLAR_AZIMUTH")
OFF_NADIR = ("OFF_NADIR", "OFFNADIR", "VIEW_OFF_NADIR")
VIEW_AZIMUTH = ("VIEW_AZIMUTH", "SAT_AZIMUTH", "SATELLITE_AZIMUTH")


def control_points(spark: SparkSession, path: str, to_place=None) -> DataFrame:
    """u, v, elevation of a CSV with a header: height in height_m, elevation or height; position in u and v, else in
    lon and lat (mapped by ``to_place``), else in x and y (likewise).  Rows outside the scene are left out."""
    raw = spark.read.option("header", True).csv(path)
    named = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    number = lambda *names: F.coalesce(*[F.col(f"`{named[n]}`").try_cast("double") for n in names if n in named], F.lit(None).cast("double"))
    u, v = number("u"), number("v")
    for x, y in (("lon", "lat"), ("x", "y")):
        if x in named and y in named and to_place is not None:
            pu, pv = to_place(number(x), number(y), x == "lon")
            u, v = F.coalesce(u, pu), F.coalesce(v, pv)
    points = raw.select(u.alias("u"), v.alias("v"), number("height_m", "elevation", "height").alias("elevation"))
    return points.where("u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND elevation IS NOT NULL")


def affine_place(origin_x: float, origin_y: float, gsd: float, width: int, height: int):
    """Places of projected (or, through UTM, geographic) coordinates in a north-up scene."""

    def place(x: Column, y: Column, geographic: bool) -> tuple[Column, Column]:
        east, north = geo.utm(x, y) if geographic else (x, y)
        return (east - origin_x) / (gsd * width), (origin_y - north) / (gsd * height)

    return place


FEATURES = "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """properties and rings (arrays of [x, y]) of the polygons in GeoJSON files; a bare feature counts as a collection,
    and each part of a multipolygon is a row.  Only outer rings are kept."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", FEATURES).alias("j"))
    one = F.array(F.struct(F.col("j.properties").alias("properties"), F.col("j.geometry").alias("geometry")))
    each = whole.select(F.explode(F.coalesce("j.features", one)).alias("f")).select("f.properties", "f.geometry")
    ring = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    parts = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    outer = F.when(F.col("geometry.type") == "MultiPolygon", F.transform(parts, lambda p: p[0])).when(F.col("geometry.type") == "Polygon", F.array(ring[0]))
    return each.select("properties", F.explode(outer).alias("ring"))


def covered_cells(polygons: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """key, r, c of the cells whose middle lies in a polygon (``ring`` in cell coordinates); a later key wins a cell.

    Every polygon makes the cells of its own bounds only, and a ray to the right decides."""
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    bounds = {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}
    box = polygons.select(key, "ring", *[e.alias(n) for n, e in bounds.items()])
    span = lambda a, b, n: F.sequence(F.greatest(F.lit(0), F.floor(a)), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(b))))
    cells = box.withColumn("r", F.explode(span("y0", "y1", height))).withColumn("c", F.explode(span("x0", "x1", width)))
    x, y = F.col("c") + 0.5, F.col("r") + 0.5
    sides = F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(sides, lambda s: ((s["a"][1] > y) != (s["b"][1] > y)) & (x < (s["b"][0] - s["a"][0]) * (y - s["a"][1]) / (s["b"][1] - s["a"][1]) + s["a"][0]))
    return cells.where(F.size(crossed) % 2 == 1).groupBy("r", "c").agg(F.max(key).alias(key))


def scene_tags(tags: Column) -> dict[str, Column]:
    """Sun and view from a map of tags, names in any case.  For the sun a value that is no number gives way to the next
    name; for the view the first name that is present counts."""
    upper = F.map_from_entries(F.transform(F.map_entries(tags), lambda e: F.struct(F.upper(e["key"]), e["value"])))
    first = lambda names: F.coalesce(*[F.try_element_at(upper, F.lit(n)) for n in names])
    numbers = lambda names: F.coalesce(*[F.try_element_at(upper, F.lit(n)).try_cast("double") for n in names])
    return {"sun_el": numbers(SUN_ELEVATION), "sun_az": numbers(SUN_AZIMUTH), "off_nadir": first(OFF_NADIR).try_cast("double"), "view_az": first(VIEW_AZIMUTH).try_cast("double")}


def mosaic(layers: DataFrame, order: str, value: str) -> DataFrame:
    """One value per cell of overlapping elevation files: that of the first file that has one."""
    return layers.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("scene", "r", "c").agg(F.min_by(value, order).alias(value))


METADATA = "cells long, height long, width long, lowest double, highest double, buildings_p95 double"


def saved_scenes(spark: SparkSession, path: str) -> DataFrame:
    """The index of saved scenes, a row for each that can be read: entries whose JSON is damaged, or that lack a size, are
    left out, as are files that vanish meanwhile."""
    index = spark.read.schema(f"scene long, {METADATA}, damaged string").option("columnNameOfCorruptRecord", "damaged").option("mode", "PERMISSIVE")
    # The damaged column must be kept until it has decided, else the reader does not parse the rest.
    found = index.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).json(path)
    return found.where("damaged IS NULL AND cells IS NOT NULL").drop("damaged")


def load_scenes(spark: SparkSession, path: str, scenes: list[int], values: list[str] | None = None) -> DataFrame:
    """Cells of the scenes named, and of these only; with ``values`` only these columns."""
    cells = spark.read.parquet(path).where(F.col("scene").isin(scenes))
    return cells if values is None else cells.select("scene", "r", "c", *values)
