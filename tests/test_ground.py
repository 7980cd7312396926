"""Ground of scenes from elevation files of other geometry."""

from __future__ import annotations

import pytest

from gridloom.plans import ground

H, W = 8, 12
LAYER = "scene long, file int, r long, c long, z double, step_r double, start_r double, step_c double, start_c double, rows int, cols int"


def layer(scene, file, z, rows, cols, step=0.5, start=-0.25):
    return [(scene, file, r, c, z(r, c), step, start, step, start, rows, cols) for r in range(rows) for c in range(cols)]


@pytest.fixture(scope="module")
def layers(spark):
    rows = layer(0, 1, lambda r, c: None if c == 5 else 100.0, 4, 6) + layer(0, 2, lambda r, c: 40.0, 4, 6)
    rows += layer(1, 1, lambda r, c: 10.0 * c, 4, 3) + layer(2, 1, lambda r, c: 5.0, 4, 6, 0.5, 50.0)
    return spark.createDataFrame(rows, LAYER)


def heights_of(df, scene):
    return {(x.r, x.c): x.z for x in df.where(f"scene = {scene}").collect()}


def test_first_file_wins_and_the_next_fills_its_gaps(layers):
    found = heights_of(ground.laid(layers, H, W), 0)
    # The gap in the last column of the first file leaves the target cells that only it reaches.
    assert len(found) == H * W and found[0, 0] == 100.0 and found[0, 11] == 40.0 and found[0, 8] == 100.0


def test_ground_is_filled_moved_and_whole(spark, layers):
    scenes = spark.createDataFrame(
        [(0, "/d/Copernicus_DSM.tif", None, None, None, None), (1, "/d/cdne43h.tif", None, None, -30.0, -20.0), (2, "/d/x.tif", None, 1.0, None, None)],
        "scene long, path string, tag string, manual double, tagged double, measured double",
    )
    found, told = ground.ground_model(layers, scenes, H, W, 0.0)
    assert {tuple(x) for x in told.collect()} == {(0, "copernicus_glo30", "EGM2008"), (1, "cartodem", "WGS84 ellipsoid (CartoDEM V3R1)")}
    one = heights_of(found, 1)
    # The file ends in the middle of the scene; beyond it the last height goes on, and the tag's geoid is taken off.
    assert len(one) == H * W and one[0, 0] == 30.0 and one[3, 11] == 50.0
    assert not heights_of(found, 2)


def test_geoid_counts_only_where_it_is_whole(spark, layers):
    scenes = spark.createDataFrame([(s, "/d/cdne43h.tif", None, None, -30.0, None) for s in (0, 1)], "scene long, path string, tag string, manual double, tagged double, measured double")
    geoid = spark.createDataFrame([(s, r, c, -44.0) for s in (0, 1) for r in range(H) for c in range(W) if s == 0 or c > 0], "scene long, r long, c long, n double")
    moved, _ = ground.sea_level(ground.laid(layers, H, W), scenes, H, W, geoid)
    assert heights_of(moved, 0)[0, 0] == 144.0 and heights_of(moved, 1)[0, 0] == 30.0


def test_blur_keeps_a_plain(spark):
    flat = spark.createDataFrame(layer(0, 1, lambda r, c: 7.0, 4, 6), LAYER)
    scenes = spark.createDataFrame([(0, "/d/srtm.tif", None, 2.5, None, None)], "scene long, path string, tag string, manual double, tagged double, measured double")
    found, _ = ground.ground_model(flat, scenes, H, W, 0.8)
    assert all(z == pytest.approx(9.5) for z in heights_of(found, 0).values())
