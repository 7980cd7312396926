"""Operators on small grids whose results are known."""

from __future__ import annotations

import datetime
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, solar
from gridloom.functions import terrain as rules
from gridloom.operators import calibration, distance, graph, hydrology, neighbours, statistics
from gridloom.plans import terrain


def grid_of(spark, rows, name="z"):
    return spark.createDataFrame([(0, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], f"scene long, r long, c long, {name} {'boolean' if isinstance(rows[0][0], bool) else 'double'}")


def test_sun_position(spark):
    up, az = solar.sun_position(F.lit(datetime.datetime(2024, 3, 20, 6, 51)).cast("timestamp"), F.lit(28.61), F.lit(77.21))
    row = spark.range(1).select(up.alias("up"), az.alias("az")).first()
    assert abs(row.up - 61.39) < 1.5 and abs(row.az - 180) < 5


def test_walking_is_fastest_slightly_downhill(spark):
    rows = spark.createDataFrame([(x,) for x in (-0.05, 0.0, 0.2, -0.3)], "s double").select("s", rules.tobler_speed(F.col("s")).alias("v")).collect()
    assert max(rows, key=lambda r: r.v).s == -0.05 and abs(rows[0].v - 6 / 3.6) < 1e-12


def test_tile_names(spark):
    name = lambda *b: spark.range(1).select(geo.tile_names(*map(F.lit, b)).alias("n")).first().n
    assert name(88.3, 27.1, 88.4, 27.2) == ["Copernicus_DSM_COG_10_N27_00_E088_00_DEM"]
    assert len(name(87.9, 26.9, 88.1, 27.1)) == 4


def test_sources_by_name(spark):
    paths = spark.createDataFrame([("x/cdng45e.tif",), ("srtm_n27.tif",), ("own.tif",)], "p string")
    assert [r[0] for r in paths.select(rules.dem_source(F.col("p"), F.lit(None).cast("string"))).collect()] == ["cartodem", "srtm", "own"]


def test_robust_scale_rejects_the_outlier(spark):
    rows = [(1, 0.05 * k, 5.0 * k, 1.0) for k in range(1, 8)] + [(1, 0.5, 500.0, 1.0)]
    fit = statistics.robust_scale(spark.createDataFrame(rows, "g int, rel double, h double, w double"), ["g"]).first()
    assert abs(fit.scale - 100) < 1e-9 and fit.inliers == 7


def test_metrics_need_ten_pairs(spark):
    few = spark.createDataFrame([(1, float(k), float(k)) for k in range(9)], "g int, pred double, ref double")
    row = statistics.accuracy(few, ["g"]).first()
    assert row.n == 9 and row.rmse is None


def test_tile_origins():
    assert neighbours.tile_origins(100, 200, 50) == [0] and neighbours.tile_origins(100, 40, 20) == [0, 20, 40, 60]


def flooded(z, eps):
    """Priority flood from the border with a heap."""
    h, w = len(z), len(z[0])
    out, done = [row[:] for row in z], set()
    heap = [(z[r][c], r, c) for r in range(h) for c in range(w) if r in (0, h - 1) or c in (0, w - 1)]
    done.update((r, c) for _, r, c in heap)
    heapq.heapify(heap)
    while heap:
        e, r, c = heapq.heappop(heap)
        for dr, dc in neighbours.OFFSETS:
            p = (r + dr, c + dc)
            if 0 <= p[0] < h and 0 <= p[1] < w and p not in done:
                done.add(p)
                if out[p[0]][p[1]] <= e:
                    out[p[0]][p[1]] = e + eps
                heapq.heappush(heap, (out[p[0]][p[1]], *p))
    return out


def test_fill_equals_a_flood_by_heap(spark):
    rng = random.Random(3)
    z = [[float(rng.randint(0, 20)) for _ in range(9)] for _ in range(8)]
    got = {(x.r, x.c): x.level for x in hydrology.filled(grid_of(spark, z), "z", 0.25, 8, 9).collect()}
    want = flooded(z, 0.25)
    assert all(got[r, c] == want[r][c] for r in range(8) for c in range(9))


def test_height_above_drainage_of_a_valley(spark):
    z = [[2.0 * abs(c - 6) + 10 * (1 - r / 11) for c in range(13)] for r in range(12)]
    pointers = hydrology.flow(hydrology.filled(grid_of(spark, z), "z", 1e-6, 12, 13), "level", 13)
    lines = hydrology.drainage(hydrology.accumulation(pointers), 12)
    above = {x.node: x.above for x in hydrology.height_above(pointers, lines).collect()}
    assert above[10 * 13 + 6] == pytest.approx(0, abs=1e-3) and above[10 * 13 + 1] > 5


def test_distance_is_exact(spark):
    rng = random.Random(5)
    mask = [[rng.random() < 0.08 for _ in range(11)] for _ in range(10)]
    mask[3][4] = True
    got = {(x.r, x.c): x.dist2 for x in distance.nearest(grid_of(spark, mask, "m"), "m", 11).collect()}
    hits = [(r, c) for r in range(10) for c in range(11) if mask[r][c]]
    assert all(got[r, c] == min((r - a) ** 2 + (c - b) ** 2 for a, b in hits) for r in range(10) for c in range(11))


def test_distance_without_a_hit_is_null(spark):
    got = distance.nearest(grid_of(spark, [[False, False]], "m"), "m", 2).collect()
    assert all(x.dist2 is None and x.source is None for x in got)


def test_components_and_holes(spark):
    mask = [[x == "#" for x in row] for row in ("###.#", "#.#..", "####.", "....#")]
    cells = grid_of(spark, mask, "m")
    labels = {(x.r, x.c): x.label for x in graph.components(cells, "m", 5).collect()}
    assert labels[0, 0] == labels[2, 3] == labels[3, 4] == 0 and labels[0, 4] == 4
    assert {(x.r, x.c) for x in graph.filled_holes(cells, "m", 4, 5).where("m").collect()} - set(labels) == {(1, 1)}


def test_routes_avoid_expensive_cells(spark):
    width = 7
    cells = grid_of(spark, [[1000.0 if c == 3 else 1.0 for c in range(width)] for _ in range(5)], "mult")
    arcs = graph.edges(cells, ["mult"], width).select("scene", "src", "dst", (F.col("distance") * 0.5 * (F.col("mult_src") + F.col("mult_dst"))).alias("cost"))
    starts = spark.createDataFrame([(0, 2 * width + 6, 0.0), (0, 0, 0.0)], "scene long, node long, dist double")
    steps = graph.next_steps(arcs, graph.shortest(arcs, starts), starts)
    ends = {x.node: x.end for x in graph.ends(steps).collect()}
    assert ends[2 * width + 2] == 0 and ends[2 * width + 4] == 2 * width + 6
    paths = graph.traced(steps, spark.createDataFrame([(0, 1, 2 * width + 2)], "scene long, path long, node long")).orderBy("step").collect()
    assert [p.step for p in paths] == list(range(len(paths))) and paths[-1].node == 0
    total = {x.node: x.total for x in graph.folded(steps.withColumn("one", F.lit(1)), "one").collect()}
    assert total[0] + total[2 * width + 6] == 5 * width


def test_analysis_shape():
    assert terrain.analysis_shape(2048, 1000) == (7, 293, 143) and terrain.analysis_shape(100, 50) == (1, 100, 50)


def test_utm_of_a_known_place(spark):
    east, north = geo.utm(F.lit(88.0), F.lit(27.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n"), geo.utm_epsg(F.lit(88.0), F.lit(27.0)).alias("z")).first()
    # A degree east of the central meridian: k0 * cos(lat) * 111.6 km, more or less.
    assert row.z == 32645 and abs(row.e - 500000 - 0.9996 * 6378137 * math.radians(1) * math.cos(math.radians(27)) / math.sqrt(1 - 0.00669438 * math.sin(math.radians(27)) ** 2)) < 60
    assert 2_980_000 < row.n < 2_995_000


def test_small_falls_are_seen_in_large_sums(spark):
    from gridloom.operators import graph

    before, after = (spark.createDataFrame([(4 * 10**17,), (last,)], "label long") for last in (9, 8))
    assert graph._stable(before, "label") != graph._stable(after, "label")


def test_zone_names_of_any_rank(spark):
    def name(n):
        out, n = "", n + 1
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(65 + k) + out
        return out

    from gridloom.functions import terrain

    ranks = [0, 25, 26, 51, 701, 702, 703, 18_277, 18_278, 475_254, 2**31 - 1]
    got = spark.createDataFrame([(n,) for n in ranks], "rank int").select("rank", terrain.zone_name(F.col("rank")).alias("name")).collect()
    assert {r.rank: r.name for r in got} == {n: name(n) for n in ranks}


def test_nearest_takes_the_lowest_parabola(spark):
    """Dense and sparse masks, ties, a scene without a mask cell, and lines longer than a batch of Arrow."""
    import random

    from gridloom.operators.distance import nearest

    own, height, width = random.Random(11), 13, 37
    rows = [(s, r, c, own.random() < share) for s, share in enumerate((0.5, 0.03, 0.0)) for r in range(height) for c in range(width)]
    cells = spark.createDataFrame(rows, "scene int, r long, c long, hit boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = nearest(cells, "hit", width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows) and nearest(cells.where("false"), "hit", width).count() == 0
    for x in found:
        near = [((x.r - r) ** 2 + (x.c - c) ** 2, r * width + c) for s, r, c, hit in rows if hit and s == x.scene]
        assert (x.dist2, x.source) == min(near, default=(None, None))


def test_quantile_by_ranges_is_exact(spark):
    """Many and few values, ties, a null group, NaN and nulls, one value, no group at all, an empty table."""
    import random

    import numpy as np

    from gridloom.operators.statistics import quantile

    own = random.Random(3)
    rows = [("wide", own.gauss(0, 1000)) for _ in range(501)] + [("tied", float(own.randint(0, 3))) for _ in range(100)] + [(None, own.random()) for _ in range(40)]
    rows += [("one", 7.0), ("gone", None), ("gone", float("nan")), ("wide", None), ("wide", float("nan"))]
    table = spark.createDataFrame(rows, "g string, x double")
    held = {g: [x for k, x in rows if k == g and x is not None and x == x] for g in ("wide", "tied", None, "one")}
    for q in (0.0, 0.25, 0.5, 0.98, 1.0):
        found = {r.g: r.q for r in quantile(table, ["g"], "x", q).collect()}
        assert found.keys() == held.keys() and all(abs(found[g] - np.quantile(held[g], q)) < 1e-9 for g in held)
    (all_of_it,) = quantile(table, [], "x", 0.5).collect()
    assert abs(all_of_it.q - np.median(sum(held.values(), []))) < 1e-9
    assert quantile(table.where("false"), ["g"], "x", 0.5).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_works_no_frame_out_anew_for_every_row(spark):
    cells = spark.createDataFrame([(0, r, c, (r * 7 + c * 3) % 11 == 0) for r in range(9) for c in range(7)], "scene long, r long, c long, z boolean")
    assert "unboundedfollowing" not in _plan(distance.nearest(cells, "z", 7))


def test_filled_gaps_work_no_frame_out_anew_for_every_row(spark):
    cells = spark.createDataFrame([(0, r, c, None if (r + c) % 3 else r) for r in range(9) for c in range(7)], "scene long, r long, c long, z long")
    assert "unboundedfollowing" not in _plan(calibration.filled_gaps(cells, "z", 7))


def test_leave_one_out_meets_no_array_of_ratios(spark):
    """Against plain loops, with equal ratios, weights that tie, and an anchor that cannot be used."""
    rng = random.Random(3)
    rows = [(g, rng.choice([0.5, 0.25, 1.0]), float(rng.randint(1, 12)), float(rng.randint(1, 4))) for g in (1, 2, 3) for _ in range(1 + 12 * (g - 1))]
    held = spark.createDataFrame([*rows, (2, 0.001, 5.0, 3.0)], "g int, rel double, h double, w double")
    found = statistics.leave_one_out(held, ["g"])
    assert "collect_list" not in _plan(found)
    for x in found.collect():
        mine, off = [r for r in rows if r[0] == x.g], []
        for k, (_, rel, h, _w) in enumerate(mine):
            rest = sorted((b / a, w) for j, (_, a, b, w) in enumerate(mine) if j != k)
            run, half = 0.0, sum(w for _, w in rest) / 2
            for v, w in rest:
                run += w
                if sum(b for a, b in rest if a <= v) >= half:
                    off.append(v * rel - h)
                    break
        wanted = (math.sqrt(sum(e * e for e in off) / len(off)), sum(map(abs, off)) / len(off)) if off else (None, None)
        assert (x.loo_rmse, x.loo_mae) == (pytest.approx(wanted[0]), pytest.approx(wanted[1])) if off else (x.loo_rmse, x.loo_mae) == wanted


def test_trimmed_affine_keeps_no_groups_values(spark, monkeypatch):
    """Medians and cuts come from ranges of values, never from an aggregate that holds a group."""
    for name in ("median", "percentile"):
        monkeypatch.setattr(F, name, None)
    rows = [(g, float(x), 3.0 * x + g + (500.0 if x % 25 == 0 else 0.0)) for g in (1, 2) for x in range(100)]
    found = {r.g: (r.a, r.b) for r in statistics.trimmed_affine(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert found == {g: (pytest.approx(3.0), pytest.approx(float(g))) for g in (1, 2)}


def test_quantile_moves_only_the_ranges_that_hold_the_rank(spark):
    import re

    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    found = statistics.quantile(rows, ["g"], "v", 0.5)
    assert not re.search(r"hashpartitioning\(g0#\w+, v#", _plan(found))
    assert {r.g: r.q for r in found.collect()} == {r.g: r.m for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()}


@pytest.mark.parametrize(("height", "width", "tile", "stride"), [(50, 7, 24, 12), (24, 30, 24, 12), (25, 9, 10, 4), (41, 20, 10, 10)])
def test_tiles_are_reckoned_not_listed(spark, height, width, tile, stride):
    """A longer grid makes no longer plan, and the tiles are those of ``tile_origins``."""
    cells = grid_of(spark, [[0.0] * width for _ in range(height)])
    origins = [neighbours.tile_origins(n, tile, stride) for n in (height, width)]
    wanted = sorted((r, c, a, b) for r in range(height) for c in range(width) for a in origins[0] if a <= r < a + tile for b in origins[1] if b <= c < b + tile)
    assert sorted((x.r, x.c, x.tr, x.tc) for x in neighbours.tiled(cells, tile, stride, height, width).collect()) == wanted
    assert len(_plan(neighbours.tiled(cells, tile, stride, 10_000_000, width))) < 20_000


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_across_many_strips(spark, monkeypatch, diagonal):
    """Strips of two rows, united two at a time; snakes that go up and down through all of them."""
    from gridloom.operators import strips

    monkeypatch.setattr(strips, "CELLS", 2)
    monkeypatch.setattr(strips, "FAN", 2)
    rng, height, width = random.Random(8), 23, 9
    held = [[(c % 4 == 0 or (c % 4 == 2 and r == (0 if c % 8 == 2 else height - 1))) if s == 0 else rng.random() < 0.55 for c in range(width)] for s in (0, 1) for r in range(height)]
    held = [held[:height], held[height:]]
    cells = spark.createDataFrame([(s, r, c, held[s][r][c]) for s in (0, 1) for r in range(height) for c in range(width)], "scene long, r long, c long, m boolean")
    found = {(x.scene, x.r, x.c): x.label for x in graph.components(cells, "m", width, diagonal).collect()}
    wanted = {}
    for s in (0, 1):
        for r in range(height):
            for c in range(width):
                if held[s][r][c] and (s, r, c) not in wanted:
                    label, todo = r * width + c, [(r, c)]
                    while todo:
                        y, x = todo.pop()
                        if 0 <= y < height and 0 <= x < width and held[s][y][x] and (s, y, x) not in wanted:
                            wanted[s, y, x] = label
                            todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or a * b == 0]
    assert found == wanted
    wet = graph.reached(cells.withColumn("seed", (F.col("r") == height - 1) & (F.col("c") == 0)), "m", "seed", width)
    if diagonal:
        first = {k for k, v in wanted.items() if v == wanted.get((k[0], height - 1, 0))}
        assert {(x.scene, x.r, x.c) for x in wet.where("reached").collect()} == first and wet.count() == 2 * height * width


def test_components_take_few_jobs(spark):
    """A long snake inside one strip is settled at once, whatever its length."""
    from gridloom import storage
    from gridloom.operators import strips

    names, plain = [], storage.settle
    cells = spark.range(40 * 20).select(F.lit(0).cast("long").alias("scene"), F.expr("id div 20").alias("r"), F.expr("id % 20").alias("c"))
    snake = cells.withColumn("m", (F.col("r") % 2 == 0) | (F.col("c") == F.when(F.col("r") % 4 == 1, 19).otherwise(0)))
    for module in (graph, strips):
        module.settle = lambda df, label="": names.append(label) or plain(df, label)
    try:
        assert graph.components(snake, "m", 20).select("label").distinct().count() == 1
    finally:
        graph.settle = strips.settle = plain
    assert len(names) <= 2


def test_walks_folds_ends_and_traces_across_ranges(spark, monkeypatch):
    """Strips of two rows and ranges of ten nodes, against arcs and against single steps along the pointers."""
    from gridloom.operators import strips

    monkeypatch.setattr(strips, "CELLS", 10)
    rng, height, width = random.Random(4), 9, 5
    z = [[float(rng.randint(0, 6)) for _ in range(width)] for _ in range(height)]
    cells = grid_of(spark, z).withColumn("start", F.when((F.col("c") == 0) & (F.col("r") % 8 == 0), 0))
    monkeypatch.setattr(graph, "edges", None)  # no table of arcs
    walk = graph.walked(cells, ["z"], lambda k, d: (d * 100 + F.abs(F.col("z") - F.col(f"z_{k}"))).cast("long"), "start", width)
    walk = walk.drop("r", "c").cache()
    held = {x.node: (x.dist, x.next) for x in walk.collect()}
    cost = lambda a, b: int(math.hypot(a // width - b // width, a % width - b % width) * 100 + abs(z[a // width][a % width] - z[b // width][b % width]))
    beside = lambda n: [r * width + c for r in range(n // width - 1, n // width + 2) for c in range(n % width - 1, n % width + 2) if 0 <= r < height and 0 <= c < width and r * width + c != n]
    best, todo = {}, [(0, 0), (0, 8 * width)]
    while todo:
        d, n = heapq.heappop(todo)
        if best.setdefault(n, d) == d:
            for m in beside(n):
                if m not in best:
                    heapq.heappush(todo, (d + cost(m, n), m))
    assert {n: d for n, (d, _) in held.items()} == best
    assert all(to is None if n in (0, 8 * width) else to == min((best[m] + cost(n, m), m) for m in beside(n))[1] for n, (_, to) in held.items())
    total, last, steps = {n: 0 for n in held}, {}, set()
    for n in held:
        at, k = n, 0
        while True:
            total[at] += n
            steps.add((n, k, at))
            if held[at][1] is None:
                break
            at, k = held[at][1], k + 1
        last[n] = at
    assert {x.node: x.end for x in graph.ends(walk).collect()} == last
    assert {x.node: x.total for x in graph.folded(walk.withColumn("w", F.col("node")), "w").collect()} == total
    assert {(x.path, x.step, x.node) for x in graph.traced(walk, walk.select("scene", F.col("node").alias("path"), "node")).collect()} == steps
    full = hydrology.filled(grid_of(spark, z), "z", 0.5, height, width)
    level = {x.r * width + x.c: x.level for x in full.collect()}
    lows = {n: z[n // width][n % width] for n in range(height * width)}
    for n, v in level.items():
        if len(beside(n)) == 8:
            least = min(level[m] for m in beside(n))
            assert v == (lows[n] if lows[n] > least else least + 0.5)
        else:
            assert v == lows[n]
