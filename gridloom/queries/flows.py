"""Components, floods, drainage, distances and walking times over the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distance, graph, hydrology
from ..plans import terrain
from ..sources.grid import grid
from ..storage import settle, table
from . import EDGES, GRID, NODES, OFFSETS

W = 64


def _height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def components_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = graph.components(grid(spark, sf_dir).withColumn("m", F.col("z") > 80), "m", W)
    return graph.ranked_components(labels, 4, 40).select("label", "n", "rank")


def patches_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform patches joined by sides only, by size."""
    labels = graph.components(grid(spark, sf_dir).withColumn("m", F.col("z") > 20), "m", W, diagonal=False)
    return labels.groupBy("label").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("patches"))


def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = graph.filled_holes(grid(spark, sf_dir).withColumn("m", F.col("z") < 60), "m", _height(spark, sf_dir), W)
    return whole.groupBy("r").agg(F.count_if("m").alias("n"))


def flood_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("reach", F.col("z") < 40).withColumn("seed", F.col("z") < -280)
    return graph.reached(cells, "reach", "seed", W).groupBy("r").agg(F.count_if("reached").alias("n"))


def water_body_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bodies = terrain.water_bodies(grid(spark, sf_dir).withColumn("water", F.col("z") < -40), _height(spark, sf_dir), W, 6)
    return bodies.select("label", "n", "rank", "kind", "r", "c")


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, so that sums and ties are the same everywhere: a step is 1024 units."""
    return grid(spark, sf_dir).withColumn("z", (F.col("z") + 40 * F.col("r")) * 1024)


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(hydrology.flow(hydrology.filled(_tilted(spark, sf_dir), "z", 1, _height(spark, sf_dir), W), "level", W), "flow")


def priority_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.filled(_tilted(spark, sf_dir), "z", 1, _height(spark, sf_dir), W).select("r", "c", "level")


def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hydrology.accumulation(_flow(spark, sf_dir)).select("node", "total")


def drainage_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = _flow(spark, sf_dir)
    lines = settle(hydrology.drainage(hydrology.accumulation(pointers), 60), "drainage")
    return hydrology.height_above(pointers, lines).select("node", "end", "above")


def height_above_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pointers = _flow(spark, sf_dir)
    cells = grid(spark, sf_dir).withColumn("water", F.col("z") < -200)
    node = (F.col("r") * W + F.col("c")).alias("node")
    near = distance.nearest(cells, "water", W).select("scene", node, "source")
    return hydrology.height_above_sources(pointers, cells.where("water").select("scene", node), near).select("node", "above")


def debris_runout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that debris from steep sources reaches within ten steps down the flow."""
    node = (F.col("r") * W + F.col("c")).alias("node")
    seeds = grid(spark, sf_dir).where("z > 250").select("scene", node)
    return graph.steps_from(_flow(spark, sf_dir).select("scene", "node", "next"), seeds, 10).select("node", "step")


def nearest_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("building", F.col("z") > 220)
    return distance.nearest(cells, "building", W).select("r", "c", "dist2", "source")


def _hard(c: str) -> Column:
    return F.when(F.col(c) > 120, 3).otherwise(0)


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Arcs with whole costs, and the safe cells."""
    arcs = graph.edges(grid(spark, sf_dir), ["z"], W)
    cost = F.when(F.col("distance") > 1, 141).otherwise(100) * (1 + _hard("z_src") + _hard("z_dst"))
    safe = grid(spark, sf_dir).where("z < -250").select("scene", (F.col("r") * W + F.col("c")).alias("node"), F.lit(0).cast("long").alias("dist"))
    return settle(arcs.select("scene", "src", "dst", cost.cast("long").alias("cost")), "routes"), settle(safe, "safe")


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = grid(spark, sf_dir).withColumn("safe", F.when(F.col("z") < -250, 0))
    cost = lambda k, distance: ((141 if distance > 1 else 100) * (1 + _hard("z") + _hard(f"z_{k}"))).cast("long")
    return graph.walked(cells, ["z"], cost, "safe", W).drop("r", "c")


def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir)[0].groupBy("cost").agg(F.count("*").alias("n"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


def evacuation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, safe = _routes(spark, sf_dir)
    return graph.shortest(arcs, safe).select("node", "dist")


def target_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ends(_field(spark, sf_dir)).groupBy(F.col("end").alias("target")).agg(F.count("*").alias("cells"), F.sum("node").alias("nodes"))


def people_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = grid(spark, sf_dir).select("scene", (F.col("r") * W + F.col("c")).alias("node"), (F.abs("z") % 5).alias("people"))
    return graph.folded(_field(spark, sf_dir).join(people, ["scene", "node"]), "people").select("node", "total")


def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways from the far column, cell by cell."""
    start = grid(spark, sf_dir).where("c = 63").select("scene", F.col("r").alias("path"), (F.col("r") * W + F.col("c")).alias("node"))
    return graph.traced(_field(spark, sf_dir), start).select("path", "step", "node")


QUERIES = {
    f.__name__: f
    for f in (
        components_topk, patches_four, fill_holes, flood_reach, water_body_kind, priority_fill, flow_accumulation, drainage_hand, height_above_sources, debris_runout, nearest_building, route_edges,
        evacuation_time, target_assignment, people_flow, trace_path,
    )
}

_H = "h AS (SELECT count(*) AS h FROM embeddings)"
_BASE = f"{GRID}, {NODES}, {OFFSETS}, {EDGES}, {_H}"


def _labels(name: str, mask: str, arcs: str = "e", keep: str = "true") -> str:
    """Components of the cells in a mask (over s.z): smallest node reachable."""
    return f"""{name}m AS MATERIALIZED (SELECT node, r, c FROM s WHERE {mask}),
        {name}(n, label) USING KEY (n) AS (SELECT node, node FROM {name}m UNION
            SELECT e.dst, min({name}.label) FROM {name} JOIN {arcs} e ON e.src = {name}.n AND {keep} JOIN {name}m m ON m.node = e.dst
            LEFT JOIN recurring.{name} k ON k.n = e.dst WHERE k.label IS NULL OR {name}.label < k.label GROUP BY e.dst)"""


_TILT = f"""{GRID}, {_H}, s AS MATERIALIZED (SELECT r, c, r * 64 + c AS node, (z + 40 * r) * 1024 AS z FROM g), {OFFSETS}, {EDGES}"""
_FILL = f"""{_TILT}, w(n, lev) USING KEY (n) AS (SELECT node, z FROM s, h WHERE r = 0 OR c = 0 OR c = 63 OR r = h - 1 UNION
        SELECT q.dst, min(q.v) FROM (SELECT e.dst, CASE WHEN e.zb > w.lev THEN e.zb ELSE w.lev + 1 END AS v FROM w JOIN e ON e.src = w.n) q
        LEFT JOIN recurring.w k ON k.n = q.dst WHERE k.lev IS NULL OR q.v < k.lev GROUP BY q.dst)"""
_FLOW = f"""{_FILL}, fl AS MATERIALIZED (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY CAST(a.lev - b.lev AS DOUBLE) / sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) DESC, k) AS n
        FROM e JOIN w a ON a.n = e.src JOIN w b ON b.n = e.dst WHERE a.lev > b.lev) WHERE n = 1)"""
_WALK = f"{_FLOW}, walk(node, cur) AS (SELECT node, node FROM s UNION ALL SELECT walk.node, fl.dst FROM walk JOIN fl ON fl.src = walk.cur)"
_DRAIN = f"{_WALK}, acc AS MATERIALIZED (SELECT cur AS node, count(*) AS total FROM walk GROUP BY cur), dr AS MATERIALIZED (SELECT node FROM acc WHERE total >= 60)"
_STOP = """stop(node, cur) AS (SELECT node, node FROM s UNION ALL SELECT stop.node, fl.dst FROM stop JOIN fl ON fl.src = stop.cur WHERE stop.cur NOT IN (SELECT node FROM {base})),
        fin AS (SELECT node, arg_min(cur, lev) AS fin FROM stop JOIN w ON w.n = stop.cur GROUP BY node)"""
_NEAREST = """(SELECT a.r, a.c, min(struct_pack(d := (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), k := b.r * 64 + b.c)) AS best FROM g a, (SELECT r, c FROM g WHERE {mask}) b GROUP BY a.r, a.c)"""
_ROUTES = f"""{_BASE}, x AS MATERIALIZED (SELECT src, dst, CAST(CASE WHEN dr * dc <> 0 THEN 141 ELSE 100 END * (1 + CASE WHEN za > 120 THEN 3 ELSE 0 END + CASE WHEN zb > 120 THEN 3 ELSE 0 END) AS BIGINT) AS cost FROM e)"""
_TIMES = f"""{_ROUTES}, sp(n, d) USING KEY (n) AS (SELECT node, CAST(0 AS BIGINT) FROM s WHERE z < -250 UNION
        SELECT x.src, min(sp.d + x.cost) FROM sp JOIN x ON x.dst = sp.n LEFT JOIN recurring.sp k ON k.n = x.src WHERE k.d IS NULL OR sp.d + x.cost < k.d GROUP BY x.src)"""
_NEXT = f"""{_TIMES}, nx AS MATERIALIZED (SELECT x.src AS node, min(struct_pack(d := sp.d + x.cost, n := x.dst)).n AS nxt FROM x JOIN sp ON sp.n = x.dst JOIN s ON s.node = x.src WHERE s.z >= -250 GROUP BY x.src)"""
_GONE = f"{_NEXT}, go(node, cur, step) AS (SELECT node, node, CAST(0 AS BIGINT) FROM s UNION ALL SELECT go.node, nx.nxt, step + 1 FROM go JOIN nx ON nx.node = go.cur)"

ORACLES = {
    "components_topk": f"WITH RECURSIVE {_BASE}, {_labels('l', 'z > 80')} SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM l GROUP BY label HAVING count(*) >= 4 ORDER BY rank LIMIT 40",
    "patches_four": f"WITH RECURSIVE {_BASE}, {_labels('l', 'z > 20', keep='e.dr * e.dc = 0')} SELECT n, count(*) AS patches FROM (SELECT count(*) AS n FROM l GROUP BY label) GROUP BY n",
    "fill_holes": f"""WITH RECURSIVE {_BASE}, {_labels("l", "z >= 60", keep="e.dr * e.dc = 0")}, outer_ AS (SELECT DISTINCT label FROM l JOIN s ON s.node = l.n, h WHERE r = 0 OR c = 0 OR c = 63 OR r = h - 1)
        SELECT r, count(*) FILTER (z < 60 OR l.label NOT IN (SELECT label FROM outer_)) AS n FROM s LEFT JOIN l ON l.n = s.node GROUP BY r""",
    "flood_reach": f"""WITH RECURSIVE {_BASE}, {_labels("l", "z < 40")}, wet AS (SELECT DISTINCT label FROM l JOIN s ON s.node = l.n WHERE z < -280)
        SELECT r, count(*) FILTER (l.label IN (SELECT label FROM wet)) AS n FROM s LEFT JOIN l ON l.n = s.node GROUP BY r""",
    "water_body_kind": f"""WITH RECURSIVE {_BASE}, {_labels("p", "z >= -40", keep="e.dr * e.dc = 0")}, outer_ AS (SELECT DISTINCT label FROM p JOIN s ON s.node = p.n, h WHERE r = 0 OR c = 0 OR c = 63 OR r = h - 1),
        lm AS MATERIALIZED (SELECT node, r, c FROM s LEFT JOIN p ON p.n = s.node WHERE z < -40 OR p.label NOT IN (SELECT label FROM outer_)),
        l(n, label) USING KEY (n) AS (SELECT node, node FROM lm UNION SELECT e.dst, min(l.label) FROM l JOIN e ON e.src = l.n JOIN lm m ON m.node = e.dst
            LEFT JOIN recurring.l k ON k.n = e.dst WHERE k.label IS NULL OR l.label < k.label GROUP BY e.dst),
        b AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank, greatest(max(r) - min(r), max(c) - min(c)) + 1 AS side FROM l JOIN s ON s.node = l.n GROUP BY label HAVING count(*) >= 6 ORDER BY rank LIMIT 50),
        k AS MATERIALIZED (SELECT s.node, s.r, s.c, label FROM l JOIN s ON s.node = l.n WHERE label IN (SELECT label FROM b)),
        o2 AS MATERIALIZED (SELECT r, c FROM s WHERE node NOT IN (SELECT node FROM k)),
        f AS (SELECT k.label, k.r, k.c, k.node, min((k.r - o2.r) * (k.r - o2.r) + (k.c - o2.c) * (k.c - o2.c)) AS d FROM k, o2 GROUP BY ALL),
        i AS (SELECT label, r, c FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, node) = 1)
        SELECT label, n, rank, CASE WHEN side * side > 6 * n THEN 'river' ELSE 'lake / pond' END AS kind, r, c FROM b JOIN i USING (label)""",
    "priority_fill": f"WITH RECURSIVE {_FILL} SELECT n // 64 AS r, n % 64 AS c, lev AS level FROM w",
    "flow_accumulation": f"WITH RECURSIVE {_WALK} SELECT cur AS node, count(*) AS total FROM walk GROUP BY cur",
    "drainage_hand": f"WITH RECURSIVE {_DRAIN}, {_STOP.format(base='dr')} SELECT node, fin AS end, a.lev - b.lev AS above FROM fin JOIN w a ON a.n = node JOIN w b ON b.n = fin",
    "height_above_sources": f"""WITH RECURSIVE {_WALK}, src AS MATERIALIZED (SELECT r * 64 + c AS node FROM g WHERE z < -200), {_STOP.format(base="src")}, near AS {_NEAREST.format(mask="z < -200")}
        SELECT fin.node, a.lev - coalesce(m.lev, b.lev) AS above FROM fin JOIN w a ON a.n = fin.node LEFT JOIN src ON src.node = fin LEFT JOIN w m ON m.n = fin AND src.node IS NOT NULL
        JOIN near ON near.r * 64 + near.c = fin.node JOIN w b ON b.n = best.k""",
    "debris_runout": f"""WITH RECURSIVE {_FLOW}, seed AS MATERIALIZED (SELECT r * 64 + c AS node FROM g WHERE z > 250),
        d(node, step) AS (SELECT node, CAST(0 AS BIGINT) FROM seed UNION SELECT fl.dst, step + 1 FROM d JOIN fl ON fl.src = d.node WHERE step < 10)
        SELECT node, min(step) AS step FROM d GROUP BY node HAVING min(step) > 0""",
    "nearest_building": f"WITH {GRID} SELECT r, c, best.d AS dist2, best.k AS source FROM {_NEAREST.format(mask='z > 220')}",
    "route_edges": f"WITH {_ROUTES} SELECT cost, count(*) AS n, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM x GROUP BY cost",
    "evacuation_time": f"WITH RECURSIVE {_TIMES} SELECT n AS node, d AS dist FROM sp",
    "target_assignment": f"WITH RECURSIVE {_GONE}, t AS (SELECT node, arg_max(cur, step) AS target FROM go GROUP BY node) SELECT target, count(*) AS cells, CAST(sum(node) AS BIGINT) AS nodes FROM t GROUP BY target",
    "people_flow": f"WITH RECURSIVE {_GONE} SELECT cur AS node, CAST(sum(abs(z) % 5) AS BIGINT) AS total FROM go JOIN s ON s.node = go.node GROUP BY cur",
    "trace_path": f"WITH RECURSIVE {_GONE} SELECT go.node // 64 AS path, step, cur AS node FROM go WHERE go.node % 64 = 63",
}
