"""Calibration of a drawn town in several scenes that differ in what is known of them."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import calibration as cal
from gridloom.plans import heights

N, AZIMUTH = 64, 135.0
#: scene: gsd, sun elevation, prior, model of the ground
SCENES = {0: (1.0, 45.0, None, None), 1: (None, None, None, None), 2: (1.0, None, 20.0, None), 3: (None, None, None, 100.0), 4: (1.0, 45.0, None, 100.0), 5: (1.0, 5.0, None, None)}
PARAMETERS = (
    "scene long, gsd double, prior_m double, user_sun_elevation double, user_sun_azimuth double, tag_sun_elevation double, tag_sun_azimuth double, "
    "user_off_nadir double, tag_off_nadir double, user_view_azimuth double, tag_view_azimuth double, acquired timestamp, lon double, lat double"
)


def town():
    height = np.zeros((N, N))
    for i, r in enumerate(range(16, 60, 24)):
        for j, c in enumerate(range(16, 60, 24)):
            height[r : r + 10, c : c + 10] = 8 + 2 * ((i * 3 + j) % 4)
    dr, dc = math.cos(math.radians(AZIMUTH)), -math.sin(math.radians(AZIMUTH))
    shadow = np.zeros((N, N), bool)
    for r, c in zip(*np.nonzero(height), strict=True):
        for t in range(1, int(height[r, c]) + 1):
            y, x = round(r + t * dr), round(c + t * dc)
            if 0 <= y < N and 0 <= x < N and height[y, x] == 0:
                shadow[y, x] = True
    return height, shadow


@pytest.fixture(scope="module")
def calibrated(spark):
    height, shadow = town()
    rows = []
    for s, (_, _, _, dem) in SCENES.items():
        for r in range(N):
            for c in range(N):
                red, green, blue = (25, 25, 30) if shadow[r, c] else (190, 120, 110) if height[r, c] else (150, 140, 135)
                rows.append((s, r, c, red, green, blue, 0.1 + float(height[r, c]) / 40, 0.01 + (r * N + c) % 97 / 9700, dem, None))
    pixels = spark.createDataFrame(rows, "scene long, r long, c long, red int, green int, blue int, rel double, unc double, dem double, footprint long")
    known = [(s, gsd, prior, el, AZIMUTH if el else None, 90.0, 90.0 if s == 1 else None, None, None, None, None, None, None, None) for s, (gsd, el, prior, _) in SCENES.items()]
    found = heights.calibrate(pixels.repartition(4), spark.createDataFrame(known, PARAMETERS), N, N, 24, 8.0)
    return found, {x.scene: x for x in found.scenes.collect()}


def array_of(found, value, scene):
    out = np.full((N, N), np.nan)
    for x in found.cells.where(F.col("scene") == scene).select("r", "c", value).collect():
        out[x.r, x.c] = x[value]
    return out


def test_modes_follow_what_a_scene_has(calibrated):
    _, told = calibrated
    assert {s: (x.mode, x.unit, x.scale_source) for s, x in told.items()} == {
        0: ("above_ground", "m", "shadow"), 1: ("relative", "relative", None), 2: ("above_ground", "m", "user prior"), 3: ("terrain_only", "relative", None), 4: ("absolute", "m", "shadow"),
        5: ("relative", "relative", None),
    }


def test_shadows_give_metres_and_low_suns_none(calibrated):
    found, told = calibrated
    assert told[0].scale == pytest.approx(40, rel=0.2) and told[0].inliers == 4 and told[5].inliers == 0
    height, _ = town()
    off = array_of(found, "ndsm", 0) - height
    assert np.abs(np.median(off[height > 0])) < 1.5 and np.sqrt(np.mean(off**2)) < 2.0
    assert array_of(found, "ndsm", 2).max() == pytest.approx(20, rel=0.1)


def test_relative_scenes_claim_no_metres(calibrated):
    found, _ = calibrated
    cells = found.cells.where("scene = 1")
    assert cells.where("dsm <> rel OR dtm IS NOT NULL OR ndsm <> above").count() == 0
    shares = {x.confidence: x.n for x in cells.where("NOT shadow AND NOT water").groupBy("confidence").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    assert shares[2] / total == pytest.approx(0.6, abs=0.05) and shares[0] / total == pytest.approx(0.1, abs=0.05)
    assert cells.where("shadow AND confidence > 1").count() == 0


def test_ground_and_heights_are_put_together(calibrated):
    found, _ = calibrated
    height, _ = town()
    assert np.abs(array_of(found, "dsm", 3) - 100).max() == 0
    whole = found.cells.where("scene = 4")
    assert whole.where("abs(dsm - dtm - ndsm) > 1e-9 OR dtm > 100.001 OR sigma < 5").count() == 0
    assert np.median(array_of(found, "ndsm", 4)[height > 0]) == pytest.approx(np.median(height[height > 0]), abs=2)


def test_sun_and_view_by_precedence(spark):
    when = datetime.datetime(2024, 6, 21, 6)
    rows = [
        (0, None, None, 30.0, 100.0, 50.0, 200.0, 5.0, 9.0, None, 80.0, when, 88.0, 27.0), (1, None, None, 30.0, None, 50.0, 200.0, None, 9.0, None, None, when, 88.0, 27.0),
        (2, None, None, None, None, 50.0, None, None, None, 7.0, None, when, 88.0, 27.0), (3, None, None, None, None, None, None, None, None, None, None, when, None, 27.0),
    ]
    found = {x.scene: x for x in heights.resolved(spark.createDataFrame(rows, PARAMETERS)).collect()}
    assert (found[0].sun_elevation, found[0].sun_azimuth, found[0].sun_source, found[0].off_nadir, found[0].view_azimuth) == (30.0, 100.0, "entered by user", 5.0, 80.0)
    assert (found[1].sun_elevation, found[1].sun_source, found[1].off_nadir) == (50.0, "image metadata", 9.0)
    assert found[2].sun_source == "computed from acquisition time" and 80 < found[2].sun_elevation < 90
    assert (found[3].sun_source, found[3].sun_elevation) == (None, None)


def test_points_move_the_ground_and_footprints_take_their_tags(spark):
    """Ground points lie seven metres over the model; a footprint with a tag keeps its height whatever the model says."""
    height, shadow = town()
    rows = [
        (0, r, c, 150, 140, 135, 0.1 + float(height[r, c]) / 40, 0.01, 100.0, 5 if 16 <= r < 26 and 16 <= c < 26 else None) for r in range(N) for c in range(N)
    ]
    pixels = spark.createDataFrame(rows, "scene long, r long, c long, red int, green int, blue int, rel double, unc double, dem double, footprint long")
    known = spark.createDataFrame([(0, 1.0, *[None] * 12)], PARAMETERS)
    points = spark.createDataFrame([(0, 2 / 63, 3 / 63, 107.0), (0, 56 / 63, 5 / 63, 107.0), (0, 32 / 63, 2 / 63, 107.5)], "scene long, u double, v double, elevation double")
    mapped = spark.createDataFrame([(0, 5, 21.0)], "scene long, label long, h double")
    found = heights.calibrate(pixels, known, N, N, 24, 8.0, points, mapped, surface=False)
    cells = found.cells.cache()
    assert {x.dtm for x in cells.select("dtm").distinct().collect()} == {107.0}
    assert {x.ndsm for x in cells.where("label = 5").collect()} == {21.0} and cells.where("label = 5").count() == 100
    assert found.scenes.first().scale_source == "osm"


def test_shadow_walk_takes_sun_by_scene(spark):
    """Two scenes with opposite suns, and one without."""
    rows = [(s, 0, c, 1 if c == 5 else None, c != 5, az) for s, az in ((0, 90.0), (1, 270.0), (2, None)) for c in range(11)]
    cells = spark.createDataFrame(rows, "scene long, r long, c long, label long, shadow boolean, az double").withColumn("shadow", F.col("shadow") & F.col("c").between(2, 8))
    found = {x.scene: (x.length, x.valid) for x in cal.shadow_walk(cells.withColumn("most", F.lit(8)), "label", "shadow", "az", "most").collect()}
    assert found == {0: (3, True), 1: (3, True)}
