"""Masks as polygons: border edges, chained into rings.

Every side of a mask cell that faces a cell outside is an edge that runs clockwise, so the mask lies on its right.  Which
edge follows an edge depends on two neighbours only, hence windows tell it; where cells touch by a corner the edge stays
with its own cell, so polygons are joined by sides.  Edges are then pointers on cycles: doubling finds a ring's
smallest edge, and, from there, each edge's place.  Rounds are as many as the logarithm of the longest ring, and no task
holds a ring, let alone a scene, before its points are put in one array at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from . import graph
from .neighbours import OFFSETS, eight

#: Sides in the order east (top), south (right), west (bottom), north (left): the way across, the cell ahead, the cell ahead on
#: the far side, and where the edge ends, all from the cell.
SIDES = [((-1, 0), (0, 1), (-1, 1), (0, 1)), ((0, 1), (1, 0), (1, 1), (1, 1)), ((1, 0), (0, -1), (1, -1), (1, 0)), ((0, -1), (-1, 0), (-1, -1), (0, 0))]


def border_edges(cells: DataFrame, mask: str, width: int) -> DataFrame:
    """scene, cell, node, next, x, y, turn, twice: an edge, the edge that follows, where it ends, whether the border turns
    there, and twice the area between the edge and the origin."""
    around = eight(cells.select("scene", "r", "c", F.coalesce(mask, F.lit(False)).alias("m")), ["m"]).where("m")
    inside = lambda way: F.coalesce(F.col(f"m_{OFFSETS.index(way)}"), F.lit(False))
    node = lambda dr, dc, side: ((F.col("r") + dr) * width + F.col("c") + dc) * 4 + side
    edges = []
    for k, (across, ahead, far, (dy, dx)) in enumerate(SIDES):
        right, straight, left = node(0, 0, (k + 1) % 4), node(*ahead, k), node(*far, (k + 3) % 4)
        follows = F.when(~inside(ahead), right).when(~inside(far), straight).otherwise(left)
        swept = (-F.col("r"), F.col("c") + 1, F.col("r") + 1, -F.col("c"))[k]
        edges.append(
            F.when(
                ~inside(across),
                F.struct(
                    node(0, 0, k).alias("node"), follows.alias("next"), (F.col("c") + dx).alias("x"), (F.col("r") + dy).alias("y"),
                    (~inside(ahead) | inside(far)).alias("turn"), swept.alias("twice"),
                ),
            )
        )
    each = around.select("scene", (F.col("r") * width + F.col("c")).alias("cell"), F.explode(F.array(*edges)).alias("e")).where("e IS NOT NULL")
    return each.select("scene", "cell", "e.*")


def chained(edges: DataFrame) -> DataFrame:
    """scene, node, ring, place: the ring's smallest edge, and the edge's place after it."""
    state = settle(edges.select("scene", "node", "next", F.col("node").alias("ring")), "rings")
    while True:
        ahead = state.select("scene", F.col("node").alias("next"), F.col("next").alias("further"), F.col("ring").alias("other"))
        met = state.join(ahead, ["scene", "next"])
        state = settle(met.select("scene", "node", F.col("further").alias("next"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("fell")), "rings")
        if not state.where("fell").limit(1).count():
            break
    rings = state.select("scene", "node", "ring")
    last = F.col("next") == F.col("ring")
    line = edges.select("scene", "node", "next").join(rings, ["scene", "node"])
    line = settle(line.select("scene", "node", "ring", F.when(~last, F.col("next")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("left")), "places")
    while line.where("next IS NOT NULL").limit(1).count():
        ahead = line.select("scene", F.col("node").alias("next"), F.col("next").alias("further"), F.col("left").alias("more"))
        met = line.join(ahead, ["scene", "next"], "left")
        line = settle(met.select("scene", "node", "ring", F.col("further").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "places")
    longest = line.where(F.col("node") == F.col("ring")).select("scene", "ring", F.col("left").alias("whole"))
    return line.join(longest, ["scene", "ring"]).select("scene", "node", "ring", (F.col("whole") - F.col("left")).alias("place"))


def ring_corners(cells: DataFrame, mask: str, width: int) -> DataFrame:
    """scene, polygon, ring, hole, area, place, x, y: the corners of the mask's outlines.

    A polygon is a component of cells joined by sides, named by its first cell; its rings are named by their first edge;
    one runs around it, the others around its holes.  ``area`` is that inside the ring, ``place`` rises along it."""
    edges = settle(border_edges(cells, mask, width), "edges")
    placed = edges.join(chained(edges), ["scene", "node"])
    labels = graph.components(cells, mask, width, diagonal=False)
    polygons = labels.select("scene", (F.col("r") * width + F.col("c")).alias("cell"), F.col("label").alias("polygon"))
    swept = placed.groupBy("scene", "ring").agg(F.sum("twice").alias("twice"), F.min("cell").alias("cell")).join(polygons, ["scene", "cell"])
    told = swept.select("scene", "ring", "polygon", (F.col("twice") < 0).alias("hole"), (F.abs("twice") / 2).alias("area"))
    return placed.where("turn").select("scene", "ring", "place", "x", "y").join(told, ["scene", "ring"]).select("scene", "polygon", "ring", "hole", "area", "place", "x", "y")


def outlines(cells: DataFrame, mask: str, width: int) -> DataFrame:
    """scene, polygon, area, rings: one polygon a row, its outer ring before its holes, each closed and as [x, y] in cell
    coordinates; ``area`` is that of the polygon without its holes."""
    corners = ring_corners(cells, mask, width)
    way = F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    rings = corners.groupBy("scene", "polygon", "ring", "hole", "area").agg(way.alias("points"))
    closed = F.concat("points", F.slice("points", 1, 1))
    both = F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", closed.alias("points")))), lambda x: x["points"])
    return rings.groupBy("scene", "polygon").agg(F.sum(F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))).alias("area"), both.alias("rings"))
