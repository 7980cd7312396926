"""Relative heights over views and tiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import neighbours as nb
from gridloom.plans import depth


def cells_of(spark, columns, height, width, scenes=(0,)):
    rows = [(s, r, c, *[f(s, r, c) for f in columns.values()]) for s in scenes for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, ["scene", "r", "c", *columns])


def test_ellipse_rows():
    assert depth.ellipse(5) == [(-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)]
    assert depth.ellipse(1) == [(0, 0)]


@pytest.mark.parametrize("k", [3, 9])
def test_top_hat_equals_loops(spark, k):
    h, w = 14, 17
    z = {(r, c): float((r * 7919 + c * 104_729) % 101) for r in range(h) for c in range(w)}
    offsets = [(d, x) for d, half in depth.ellipse(k) for x in range(-half, half + 1)]
    swept = lambda src, pick: {(r, c): pick(src[r + d, c + x] for d, x in offsets if (r + d, c + x) in src) for r, c in src}
    opened = swept(swept(z, min), max)
    found = {(x.r, x.c): x.z for x in depth.top_hat(cells_of(spark, {"z": lambda s, r, c: z[r, c]}, h, w), "z", k).collect()}
    assert found == {k: z[k] - opened[k] for k in z}


def test_views_turn_and_come_back(spark):
    cells = spark.createDataFrame([(v, r, c) for v in range(4) for r in range(3) for c in range(5)], "v int, r int, c int")
    there = depth.turned(F.col("v"), F.col("r"), F.col("c"), 3, 5)
    moved = cells.select("v", "r", "c", there[0].alias("i"), there[1].alias("j"))
    back = depth.turned(F.col("v"), F.col("i"), F.col("j"), 3, 5, back=True)
    assert moved.select("r", "c", back[0].alias("a"), back[1].alias("b")).where("r <> a OR c <> b").count() == 0
    image = np.arange(15).reshape(3, 5)
    wanted = [image, image[:, ::-1], image[::-1], np.rot90(image)]
    assert all(wanted[x.v][x.i, x.j] == image[x.r, x.c] for x in moved.collect())


def ramp(cells, height, width):
    """A model that sees a slope, and the bumps on it, at a level and contrast of its own in every tile."""
    level = cells.groupBy("scene").agg(F.avg("red").alias("level"))
    return cells.join(level, "scene").select("scene", "r", "c", ((F.col("red") - F.col("level")) * (1 + F.col("level") / 100) + 3).alias("value"))


def test_tiles_are_blended_without_seams(spark):
    h, w, tile = 40, 64, 16
    picture = lambda s, r, c: 1.3 * r + 0.7 * c + 4 * math.sin(r / 3) * math.cos(c / 4) + 5 * s
    cells = cells_of(spark, {"red": picture}, h, w, (0, 1))
    found = depth.relative_heights(cells, ramp, h, w, tile, views=False).cache()
    assert found.count() == 2 * h * w
    borders = sorted({e for n in (h, w) for s in nb.tile_origins(n, tile, tile // 2) for e in (s, s + tile) if 0 < e < n})
    assert all(x.ratio < 1.2 for x in nb.seam_ratio(found, "rel", borders).collect())
    truth = np.array([[picture(0, r, c) for c in range(w)] for r in range(h)])
    rel = np.zeros((h, w))
    for x in found.where("scene = 0").collect():
        rel[x.r, x.c] = x.rel
    assert np.corrcoef(truth.ravel(), rel.ravel())[0, 1] > 0.999 and rel.min() == 0 and rel.max() == 1


def test_blobs_stand_out_in_every_view(spark):
    h, w = 24, 30
    spot = lambda r, c: 230 if 8 <= r < 12 and 10 <= c < 14 else 60 + c
    cells = cells_of(spark, {b: lambda s, r, c: spot(r, c) for b in ("red", "green", "blue")}, h, w)
    found = depth.relative_heights(cells, depth.bright_blobs, h, w).collect()
    best = sorted(found, key=lambda x: -x.rel)[:8]
    assert all(8 <= x.r < 12 and 10 <= x.c < 14 for x in best)
    # The model treats all ways alike, so its views agree.
    assert max(x.unc for x in found) < 0.05
