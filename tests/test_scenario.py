"""A small town through all three hazards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.plans import scenario, terrain
from gridloom.sinks import exports
from gridloom.sources import readers

SIZE = 24


@pytest.fixture(scope="module")
def ground(spark):
    """A plain that rises to the east, a river in the west, and houses of ten metres on a pitch of eight cells."""
    at = spark.range(SIZE * SIZE).select(F.lit(0).cast("long").alias("scene"), F.expr(f"id div {SIZE}").alias("r"), F.expr(f"id % {SIZE}").alias("c"))
    house = (F.col("r") % 8).isin(3, 4) & (F.col("c") % 8).isin(5, 6)
    cells = at.select(
        "scene", "r", "c", (0.5 * F.col("c") + 0.01 * F.col("r")).alias("z"), F.when(house, 10.0).otherwise(0.0).alias("ndsm"), house.alias("building"), F.lit(False).alias("tree"),
        (F.col("c") < 2).alias("water"), F.lit(0.2).alias("veg"),
    )
    found, bodies = terrain.terrain(cells, SIZE, SIZE, 5.0)
    assert [b.kind for b in bodies.collect()] == ["river"]
    return scenario.Ground(found, SIZE, SIZE, 5.0)


def test_flood_grows_with_the_level(ground):
    share = [scenario.flood(ground, level).agg(F.avg(F.col("danger").cast("double"))).first()[0] for level in (0.0, 2.0, 5.0)]
    assert share[0] < share[1] < share[2] and share[0] == pytest.approx(2 / SIZE)


def test_flood_plan(ground):
    found = scenario.run(ground, "flood", 2.0)
    zones = found.zones.collect()
    assert zones and zones[0].name == "A" and zones[0].capacity > 0
    stats = found.stats.first()
    assert stats.buildings_total == 9 and stats.people_trapped == 0 and stats.safe_zones == len(zones)
    text = scenario.summary(found.stats, found.zones, found.choke_points, "2 m flood").first().text
    assert text.startswith("Scenario: 2 m flood.") and "Main safe places: Zone A" in text
    assert '"FeatureCollection"' in exports.evacuation_geojson(found.zones, found.choke_points, SIZE, SIZE).first().geojson
    assert scenario.arrows(ground, found.cells).count() > 0


def test_a_flat_town_has_no_slides(ground):
    danger = scenario.landslide(ground, 0.5).agg(F.avg(F.col("danger").cast("double"))).first()[0]
    assert danger < 0.02


def test_an_earthquake_spares_open_ground(ground):
    cells = scenario.earthquake(ground, 1.0)
    assert cells.where("danger AND building").count() == 0 and cells.where("danger").count() > 0 and cells.where("safe AND danger").count() == 0


def test_unknown_hazard(ground):
    with pytest.raises(ValueError):
        scenario.run(ground, "storm")


def test_control_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿X , y,Height_M\n634050,3006450,1500\n0,0,3\n")
    place = readers.affine_place(634000, 3006500, 0.5, 200, 200)
    assert [tuple(r) for r in readers.control_points(spark, str(tmp_path / "a.csv"), place).collect()] == [(0.5, 0.5, 1500.0)]


def test_footprints(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"type":"Feature","properties":{"building":"yes","building:levels":"4"},"geometry":{"type":"Polygon","coordinates":[[[2,2],[6,2],[6,5],[2,5],[2,2]]]}}')
    found = readers.features(spark, str(tmp_path / "a.json"))
    assert found.first().properties["building:levels"] == "4"
    cells = readers.covered_cells(found.select(F.lit(1).alias("id"), "ring"), "id", 10, 10)
    assert cells.count() == 12


def test_tags(spark):
    row = spark.createDataFrame([({"sun_elevation": "x", "SUN_ELEV": "41.5", "OffNadir": "12"},)], "t map<string,string>")
    tags = readers.scene_tags(F.col("t"))
    assert row.select(tags["sun_el"], tags["off_nadir"], tags["view_az"]).first() == (41.5, 12.0, None)
