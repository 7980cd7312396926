"""Roofs, grids of other geometry, wide filters, outlines and places, against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import colour, geo
from gridloom.operators import calibration as cal
from gridloom.operators import outlines, regrid, roofs
from gridloom.sources.readers import covered_cells


def cells_of(spark, columns, height, width, scenes=(0,)):
    names = list(columns)
    rows = [(s, r, c, *[columns[n](s, r, c) for n in names]) for s in scenes for r in range(height) for c in range(width)]
    return spark.createDataFrame(rows, ["scene", "r", "c", *names])


def array_of(df, value, height, width, scene=0):
    out = np.full((height, width), np.nan)
    for x in df.where(F.col("scene") == scene).collect():
        out[x.r, x.c] = x[value]
    return out


def test_lab_of_known_colours(spark):
    rows = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)], "r int, g int, b int")
    found = [tuple(x) for x in rows.select(*colour.lab(F.col("r"), F.col("g"), F.col("b"))).collect()]
    wanted = [(0, 128, 128), (255, 128, 128), (136, 208, 195), (224, 42, 211), (82, 207, 20), (137, 128, 128)]
    assert found == [tuple(map(float, w)) for w in wanted]


def test_roofs_of_two_scenes(spark):
    """A red roof and a roof-coloured yard; scene 1 has no limits, hence no roof."""
    roof, yard = (lambda r, c: 4 <= r < 14 and 4 <= c < 14), (lambda r, c: 4 <= r < 14 and 18 <= c < 28)
    colours = {n: lambda s, r, c, v=v: v[0] if roof(r, c) or yard(r, c) else v[1] for n, v in {"red": (200, 60), "green": (40, 140), "blue": (40, 80)}.items()}
    cells = cells_of(spark, colours | {"rel": lambda s, r, c: 0.9 if roof(r, c) else 0.1, "shadow": lambda s, r, c: False}, 18, 32, (0, 1))
    limits = spark.createDataFrame([(0, 0.8, None)], "scene long, limit double, pixel_m2 double")
    found = {(x.scene, x.r, x.c) for x in roofs.roof_segments(cells, limits, 18, 32).where("roof").collect()}
    # The colour step takes a cell off all round and the growth gives it back; pixels of a quarter of a square metre make 64 cells too small.
    assert found == set()
    limits = limits.withColumn("pixel_m2", F.lit(1.0))
    found = {(x.scene, x.r, x.c) for x in roofs.roof_segments(cells, limits, 18, 32).where("roof").collect()}
    assert found == {(0, r, c) for r in range(4, 14) for c in range(4, 14)}


def weights(kernel, x):
    t = abs(x)
    if kernel == "linear":
        return max(0.0, 1 - t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else (-0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0)


@pytest.mark.parametrize("kernel", ["linear", "cubic"])
def test_regridded_equals_loops_with_geometry_by_scene(spark, kernel):
    random.seed(3)
    values = {(s, r, c): random.choice([None, math.nan, *[random.uniform(-9, 9)] * 6]) for s in (0, 1) for r in range(6) for c in range(5)}
    geometry = {0: (0.4, -0.3, 0.5, 0.2), 1: (1.3, 0.1, 0.7, -0.9)}
    rows = [(s, r, c, v, *geometry[s]) for (s, r, c), v in values.items()]
    cells = spark.createDataFrame(rows, "scene long, r long, c long, z double, a double, b double, d double, e double")
    found = {(x.scene, x.r, x.c): x.z for x in regrid.regridded(cells, "z", 12, 9, ("a", "b"), ("d", "e"), kernel, (6, 5)).collect()}
    wanted = {}
    for s, (a, b, d, e) in geometry.items():
        for r in range(12):
            for c in range(9):
                x, y = r * a + b, c * d + e
                if not (-0.5 <= x <= 5.5 and -0.5 <= y <= 4.5):
                    continue
                known = [(v, weights(kernel, x - i) * weights(kernel, y - j)) for (t, i, j), v in values.items() if t == s and v is not None and not math.isnan(v)]
                if (den := sum(w for _, w in known)) > 1e-6:
                    wanted[s, r, c] = sum(v * w for v, w in known) / den
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-6) for k in wanted)


def gauss(a, sigma):
    half = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    for axis in (1, 0):
        a = np.apply_along_axis(lambda line: np.convolve(np.pad(line, half, mode="symmetric"), k / k.sum(), "valid"), axis, a)
    return a


@pytest.mark.parametrize(("height", "width", "sigma"), [(30, 50, 9.0), (12, 17, 20.0), (20, 20, 2.0)])
def test_lowpass_is_near_a_full_filter(spark, height, width, sigma):
    z = lambda s, r, c: 10 * math.sin(r / 9) + 8 * math.cos(c / 7) + (r * c) % 5
    cells = cells_of(spark, {"z": z}, height, width)
    found = array_of(regrid.lowpass(cells, "z", sigma, height, width), "z", height, width)
    wanted = gauss(np.array([[z(0, r, c) for c in range(width)] for r in range(height)]), sigma)
    assert np.abs(found - wanted).max() < (1e-9 if sigma <= 4 else 0.35)


def test_terrain_removed_counts_no_building_twice(spark):
    """A surface model that holds the building blurred: the ground under it comes out flat."""
    n, building = 48, np.zeros((48, 48))
    building[16:32, 16:32] = 12.0
    dem = 100 + gauss(building, 6.0)
    cells = cells_of(spark, {"dem": lambda s, r, c: float(dem[r, c]), "ndsm": lambda s, r, c: float(building[r, c])}, n, n)
    found = regrid.terrain_removed(cells, "dem", "ndsm", 6.0, n, n)
    assert np.abs(array_of(found, "dtm", n, n) - 100).max() < 0.5
    assert np.abs(array_of(found, "dsm", n, n) - 100 - building).max() < 0.5


def test_bare_earth_widens_up_to_the_longer_side(spark):
    """Only a strip along one short side is ground: the far end takes its height, not the scene's median."""
    height, width = 8, 60
    cells = cells_of(spark, {"z": lambda s, r, c: 10.0 if c < 6 else 70.0, "building": lambda s, r, c: c >= 6}, height, width, (0,))
    found = array_of(cal.bare_earth(cells, "z", "building", height, width), "z", height, width)
    assert np.abs(found - 10).max() < 1e-6
    town = cells.withColumn("building", F.lit(True))
    assert {round(x.z, 6) for x in cal.bare_earth(town, "z", "building", height, width).select("z").distinct().collect()} == {70.0}


def mask(s, r, c):
    if s == 0:  # a ring with an island in it, and two cells that touch by a corner
        return (2 <= r < 9 and 2 <= c < 9 and not (4 <= r < 7 and 4 <= c < 7)) or (r, c) in {(5, 5), (9, 9), (0, 0)}
    random.seed(r * 100 + c)
    return random.random() < 0.55


def test_outlines_give_the_mask_back(spark):
    cells = cells_of(spark, {"m": mask}, 12, 12, (0, 1, 2)).where("scene < 2 OR m IS NULL")
    found = outlines.outlines(cells, "m", 12).collect()
    for s in (0, 1):
        parts = [x for x in found if x.scene == s]
        wanted = {(r, c) for r in range(12) for c in range(12) if mask(s, r, c)}
        assert sum(x.area for x in parts) == len(wanted)
        assert all(ring[0] == ring[-1] for x in parts for ring in x.rings)
        back = set()
        for x in parts:
            held = []
            for ring in x.rings:
                polygon = spark.createDataFrame([(1, ring[:-1])], "k int, ring array<array<double>>")
                held.append({(y.r, y.c) for y in covered_cells(polygon, "k", 12, 12).collect()})
            back |= held[0].difference(*held[1:])
        assert back == wanted
    ring = next(x for x in found if x.scene == 0 and x.area == 40)
    assert len(ring.rings) == 2 and len(ring.rings[0]) == 5 and len(ring.rings[1]) == 5


def test_outlines_of_nothing(spark):
    cells = cells_of(spark, {"m": lambda s, r, c: False}, 3, 3)
    assert outlines.outlines(cells, "m", 3).count() == 0


def test_lonlat_takes_utm_back_within_a_millimetre(spark):
    places = [(lon + 0.25, lat) for lon in range(-180, 180, 17) for lat in range(-80, 85, 11)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in places], "lon double, lat double")
    east, north = geo.utm(F.col("lon"), F.col("lat"))
    flat = df.select("lon", "lat", east.alias("e"), north.alias("n"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))
    lon, lat = geo.lonlat(F.col("e"), F.col("n"), F.col("epsg"))
    for x in flat.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        metres = math.hypot((x.a - x.lon) * 111_320 * math.cos(math.radians(x.lat)), (x.b - x.lat) * 110_540)
        assert metres < 1e-3, (x, metres)


def test_bounds_reach_beyond_the_corners(spark):
    """In the north the upper edge of a wide scene bulges towards the pole in the middle."""
    box = geo.bounds_lonlat(F.lit(300_000.0), F.lit(7_000_000.0), F.lit(700_000.0), F.lit(7_400_000.0), F.lit(32633))
    found = spark.range(1).select(box.alias("b")).select("b.*").first()
    corner = spark.range(1).select(*geo.lonlat(F.lit(300_000.0), F.lit(7_400_000.0), F.lit(32633))).first()
    assert found.north > corner[1] and found.west == pytest.approx(corner[0])


def test_wide_filter_on_a_grid_that_its_blocks_do_not_divide(spark, tmp_path):
    """As many rows as leave three over a block of four; and what rounds to zero from below keeps its sign."""
    import duckdb

    from gridloom import catalogue
    from gridloom.queries import images

    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 0.125) for _ in range(64)]) for k in range(71)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("lowpass_wide", "terrain_removal"):
        wanted = con.execute(catalogue.ORACLES[name]).fetchall()
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(wanted)
    z = spark.createDataFrame([(-4e-6,), (4e-6,), (-1.000005,)], "z double")
    assert [str(x[0]) for x in z.select(images._signed(F.col("z"), 5)).collect()] == ["-0.0", "0.0", "-1.00001"]
