"""Masks, ground and routes on small grids, against plain loops."""

from __future__ import annotations

import math

import pytest

from gridloom.operators import calibration as cal
from gridloom.plans import scenario


def cells_of(spark, columns, height, width):
    names = list(columns)
    rows = [(0, r, c, *[columns[n](r, c) for n in names]) for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, ["scene", "r", "c", *names])


def where(df, mask):
    return {(x.r, x.c) for x in df.where(mask).collect()}


def test_quantile_of_groups_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", 9.0), ("a", None), ("a", math.nan), ("b", 7.0)], "k string, v double")
    assert {x.k: x.q for x in cal.quantile(rows, ["k"], "v", 0.5).collect()} == {"a": 3.0, "b": 7.0}
    assert cal.quantile(rows.limit(0), ["k"], "v", 0.5).count() == 0


def test_object_masks_keep_large_patches_and_roofs(spark):
    cells = cells_of(
        spark, {"high": lambda r, c: r < 3 and c < 3, "veg": lambda r, c: (r, c) == (0, 0), "roof": lambda r, c: (r, c) in {(5, 5), (2, 3)}}, 6, 6
    )
    found = cal.object_masks(cells, 6, 4).cache()
    assert where(found, "building") == {(r, c) for r in range(3) for c in range(3)} - {(0, 0)} | {(2, 3)}
    assert where(found, "tree") == {(0, 0)}


def test_shadow_mask_opens_and_drops_small_patches(spark):
    dark = {(1, 1), (1, 2), (2, 1), (2, 2), (4, 4), (0, 5), (1, 5), (0, 4), (1, 4)}
    cells = cells_of(spark, {"dark": lambda r, c: (r, c) in dark, "water": lambda r, c: (r, c) == (0, 5)}, 6, 6)
    # Both steps of an opening of even size reach back, so the patch lies one cell further on.
    assert where(cal.shadow_mask(cells, "dark", "water", 6), "shadow") == {(2, 2), (2, 3), (3, 2), (3, 3)}


def test_water_regions_leave_out_raised_and_small_ones(spark):
    blue = lambda r, c: (r < 4 and c < 4) or (r < 4 and 8 <= c < 12) or (r > 8 and c > 8)
    cells = cells_of(spark, {"blue": blue, "raised": lambda r, c: c >= 8 and r < 6}, 12, 12)
    found = where(cal.water_regions(cells, "blue", "raised", 12, 3, 10), "water")
    assert found == {(r, c) for r in range(4) for c in range(4)}


@pytest.mark.parametrize("k", [4, 5])
def test_ground_surface_stays_in_place(spark, k):
    """Of a plain with a plateau the ground is symmetric about the plateau's middle, for even k as well."""
    n = 24
    cells = cells_of(spark, {"z": lambda r, c: 30.0 if 6 <= r < 18 and 6 <= c < 18 else 10.0}, n, n)
    found = {(x.r, x.c): x.z for x in cal.ground_surface(cells, "z", k, n, n).collect()}
    assert all(found[r, c] == pytest.approx(found[n - 1 - r, n - 1 - c]) for r in range(n) for c in range(n))
    assert found[12, 12] > 29 and found[0, 0] < 11


def test_bare_earth_widens_until_a_large_block_is_filled(spark):
    n = 40
    block = lambda r, c: 4 <= r < 36 and 4 <= c < 36
    cells = cells_of(spark, {"z": lambda r, c: 50.0 if block(r, c) else 10.0, "building": block}, n, n)
    found = {(x.r, x.c): x.z for x in cal.bare_earth(cells, "z", "building", n, n).collect()}
    assert len(found) == n * n
    assert all(found[r, c] == pytest.approx(10.0) for r in range(n) for c in range(n) if not (12 <= r < 28 and 12 <= c < 28))
    assert found[20, 20] == pytest.approx(10.0)


def test_filled_gaps_without_any_value(spark):
    cells = cells_of(spark, {"z": lambda r, c: math.nan}, 2, 2)
    assert {x.z for x in cal.filled_gaps(cells, "z", 2).collect()} == {0.0}


def test_route_to_a_zone_and_none(spark):
    # One row of five cells: a way from 0 to the zone at 3; cell 4 is cut off.
    rows = [(0, 0, c, t, n, z, a) for c, t, n, z, a in [(0, 90.0, 1, None, 7), (1, 60.0, 2, None, 7), (2, 30.0, 3, None, 7), (3, 0.0, None, 7, 7), (4, None, None, None, None)]]
    field = spark.createDataFrame(rows, "scene long, r long, c long, time double, next long, zone long, assigned long")
    zones = spark.createDataFrame([(0, 7, "A", "High ground")], "scene long, zone long, name string, kind string")
    asked = spark.createDataFrame([(0, 1, 0.0, 0.5), (0, 2, 0.99, 0.5), (0, 3, 0.65, 0.5)], "scene long, path int, u double, v double")
    found = {x.path: x for x in scenario.routes(scenario.Ground(field, 1, 5, 2.0), field, zones, asked).collect()}
    way = found[1]
    assert (way.reachable, way.minutes, way.distance_m, way.zone, way.kind, way.message) == (True, 1.5, 6.0, "A", "High ground", None)
    assert [p.u for p in way.points] == pytest.approx([0.1, 0.3, 0.5, 0.7])
    assert (found[2].reachable, found[2].minutes, found[2].points, found[2].message) == (False, None, None, scenario.NO_ROUTE)
    assert (found[3].distance_m, found[3].minutes) == (0.0, 0.0)
