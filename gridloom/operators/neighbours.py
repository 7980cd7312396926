"""Operators on a cell's surroundings, by windows along rows and columns.

A grid is a table (scene, r, c, ...).  Every operator works along one axis after the other, so a window holds one row
or one column of one scene, never a scene.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = {"c": ("r", "c"), "r": ("c", "r")}  # direction: (line, place in the line)
#: Fixed order, which settles ties: north-west, north, north-east, west, east, south-west, south, south-east.
OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def along(direction: str) -> Window:
    line, place = AXES[direction]
    return Window.partitionBy("scene", line).orderBy(place)


def framed(direction: str, before: int, after: int) -> Window:
    return along(direction).rowsBetween(-before, after)


def gradient(cells: DataFrame, value: str, cell: float = 1.0) -> DataFrame:
    """``gr`` and ``gc``: central differences inside, one-sided at the edges."""
    out = cells
    for d in ("r", "c"):
        back, ahead = F.lag(value).over(along(d)), F.lead(value).over(along(d))
        steps = F.when(back.isNull() | ahead.isNull(), 1.0).otherwise(2.0)
        rise = F.coalesce(ahead, F.col(value)) - F.coalesce(back, F.col(value))
        out = out.withColumn(f"g{d}", rise.cast("double") / (steps * cell))
    return out


def slope_degrees(cells: DataFrame, value: str, cell: float = 1.0) -> DataFrame:
    return gradient(cells, value, cell).withColumn("slope", F.degrees(F.atan(F.hypot("gr", "gc")))).drop("gr", "gc")


def hillshade(cells: DataFrame, value: str, cell: float = 1.0, azimuth: float = 315.0, elevation: float = 45.0, exaggerate: float = 1.0) -> DataFrame:
    """``shade``: the surface normal against the sun, 0 to 1.  Rows run south, columns east."""
    az, el = math.radians(azimuth), math.radians(elevation)
    east, north, up = math.sin(az) * math.cos(el), math.cos(az) * math.cos(el), math.sin(el)
    g = gradient(cells, value, cell)
    x, y = F.col("gc") * exaggerate, F.col("gr") * exaggerate
    lit = (-x * east + y * north + up) / F.sqrt(x * x + y * y + 1.0)
    return g.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit))).drop("gr", "gc")


def mirrored(cells: DataFrame, direction: str, margin: int, size: Column | int) -> DataFrame:
    """The cells and, on either side, ``margin`` more by reflection (the edge cell is repeated); a line shorter than the
    margin is reflected again and again, if ``size`` is a number."""
    place = AXES[direction][1]
    at, n = F.col(place), F.lit(size) if isinstance(size, int) else size
    if isinstance(size, int) and margin > size:
        turns = F.sequence(F.lit(-margin // size), F.lit(margin // size + 1))
        images = F.flatten(F.transform(turns, lambda k: F.array(at + 2 * size * k, 2 * size * k - 1 - at)))
        return cells.withColumn(place, F.explode(F.filter(images, lambda x: (x >= -margin) & (x < size + margin))))
    # One pass: a cell stands for itself and for its images, so what makes the cells is not worked out three times.
    images = F.array(at, F.when(at < margin, -1 - at), F.when(at >= n - margin, 2 * n - 1 - at))
    return cells.withColumn(place, F.explode(F.array_compact(images)))


def box_mean(cells: DataFrame, value: str, k: int, height: int, width: int) -> DataFrame:
    """``value`` averaged over k x k cells (k odd), reflected at the borders."""
    half, out = k // 2, cells
    for d, size in (("c", width), ("r", height)):
        place = AXES[d][1]
        padded = mirrored(out, d, half, size).withColumn(value, F.sum(value).over(framed(d, half, half)))
        out = padded.where((F.col(place) >= 0) & (F.col(place) < size))
    return out.withColumn(value, F.col(value) / F.lit(float(k * k)))


def local_std(cells: DataFrame, value: str, k: int, height: int, width: int) -> DataFrame:
    """``std``: deviation over k x k cells."""
    base = cells.select("scene", "r", "c", F.col(value).cast("double").alias("m"), (F.col(value) * F.col(value)).cast("double").alias("q"))
    half, out = k // 2, base
    for d, size in (("c", width), ("r", height)):
        place = AXES[d][1]
        padded = mirrored(out, d, half, size)
        out = padded.select("scene", "r", "c", *[F.sum(x).over(framed(d, half, half)).alias(x) for x in ("m", "q")]).where((F.col(place) >= 0) & (F.col(place) < size))
    m, q = (F.col(x) / F.lit(float(k * k)) for x in ("m", "q"))
    return out.select("scene", "r", "c", F.sqrt(F.greatest(q - m * m, F.lit(0.0))).alias("std"))


def gaussian(cells: DataFrame, value: str, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian filter, cut at four sigma, reflected at the borders (sigma small against the grid)."""
    half = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    weights = [w / sum(raw) for w in raw]
    out = cells.withColumn(value, F.col(value).cast("double"))
    for d, size in (("c", width), ("r", height)):
        place = AXES[d][1]
        total = reduce(lambda a, b: a + b, (w * F.lag(value, -k).over(along(d)) for k, w in zip(range(-half, half + 1), weights, strict=True)))
        out = mirrored(out, d, half, size).withColumn("filtered", total).where((F.col(place) >= 0) & (F.col(place) < size))
        out = out.withColumn(value, F.col("filtered")).drop("filtered")
    return out


def extreme(cells: DataFrame, value: str, k: int, largest: bool = True, ahead: bool = False) -> DataFrame:
    """Largest or smallest over k x k cells; what lies beyond the border does not count.  An even k reaches further
    back, or with ``ahead`` further on."""
    pick = F.max if largest else F.min
    before, after = (k - 1 - k // 2, k // 2) if ahead else (k // 2, k - 1 - k // 2)
    out = cells
    for d in ("c", "r"):
        out = out.withColumn(value, pick(value).over(framed(d, before, after)))
    return out


def dilate(cells: DataFrame, mask: str, times: int = 1) -> DataFrame:
    """Grow a boolean by the four neighbours."""
    out = cells
    for _ in range(times):
        out = out.withColumn(mask, F.greatest(*[F.max(mask).over(framed(d, 1, 1)) for d in ("c", "r")]))
    return out


def opened(cells: DataFrame, value: str, k: int) -> DataFrame:
    """With an even k both steps reach back, so what stays lies one cell further on."""
    return extreme(extreme(cells, value, k, largest=False), value, k)


def closed(cells: DataFrame, value: str, k: int) -> DataFrame:
    return extreme(extreme(cells, value, k), value, k, largest=False)


def eight(cells: DataFrame, values: list[str]) -> DataFrame:
    """For every value v, ``v_0`` to ``v_7``: those of the eight neighbours in the order of OFFSETS."""
    out = cells
    for v in values:
        for dr in (-1, 1):
            out = out.withColumn(f"{v}@{dr}", F.lag(v, -dr).over(along("r")))
    picks = []
    for v in values:
        for k, (dr, dc) in enumerate(OFFSETS):
            source = F.col(v if dr == 0 else f"`{v}@{dr}`")
            picks.append((F.lag(source, -dc).over(along("c")) if dc else source).alias(f"{v}_{k}"))
    return out.select("*", *picks).drop(*[f"{v}@{dr}" for v in values for dr in (-1, 1)])


def receivers(cells: DataFrame, value: str = "z", cell: float = 1.0) -> DataFrame:
    """``to_r``, ``to_c``: the neighbour of steepest descent; null where none lies lower; of ties the first offset."""
    around = eight(cells.select("scene", "r", "c", value), [value])
    falls = [((F.col(value) - F.col(f"{value}_{k}")).cast("double") / (cell * math.hypot(dr, dc))) for k, (dr, dc) in enumerate(OFFSETS)]
    steepest = F.greatest(*falls)
    way = F.coalesce(*[F.when(f == steepest, F.lit(k)) for k, f in enumerate(falls)])
    way = F.when(steepest > 0, way)
    dr, dc = (F.when(way.isNotNull(), F.element_at(F.array(*[F.lit(o[i]) for o in OFFSETS]), way + 1)) for i in (0, 1))
    return around.select("scene", "r", "c", value, (F.col("r") + dr).alias("to_r"), (F.col("c") + dc).alias("to_c"))


def block_mean(cells: DataFrame, value: str, block: int, height: int, width: int) -> DataFrame:
    """Means of block x block cells; an incomplete last row or column of blocks is left out."""
    whole = cells.where((F.col("r") < height // block * block) & (F.col("c") < width // block * block))
    at = [F.expr(f"{x} div {block}").alias(x) for x in ("r", "c")]
    return whole.groupBy("scene", *at).agg(F.avg(value).alias(value))


def resampled(cells: DataFrame, value: str, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Area resize to rows x cols: a cell counts for each target cell by the share that it covers of it."""
    def shares(place: str, size: int, n: int) -> Column:
        """Targets that the cell [x, x + 1) touches, and how much of it lies in each."""
        lo, hi = F.col(place) * n / float(size), (F.col(place) + 1) * n / float(size)
        targets = F.sequence(F.floor(lo), F.greatest(F.floor(lo), F.ceil(hi) - 1))
        return F.transform(targets, lambda t: F.struct(t.alias("at"), (F.least(hi, t + 1) - F.greatest(lo, t.cast("double"))).alias("w")))

    wide = cells.select("scene", value, F.explode(shares("r", height, rows)).alias("p"), "c").select("scene", value, "p", F.explode(shares("c", width, cols)).alias("q"))
    weight = F.col("p.w") * F.col("q.w")
    return wide.groupBy("scene", F.col("p.at").alias("r"), F.col("q.at").alias("c")).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias(value))


def tile_origins(length: int, tile: int, stride: int) -> list[int]:
    """Starts of overlapping tiles; the last is flush with the end."""
    return [0] if length <= tile else [*range(0, length - tile, stride), length - tile]


def taper(i: Column, n: int, flat_start: Column, flat_end: Column) -> Column:
    """Hann weight of place i of n; the half on an image edge stays flat."""
    w = F.pow(F.sin(F.lit(math.pi) * (i + 0.5) / float(n)), 2)
    return F.when(flat_start & (i < n // 2), 1.0).when(flat_end & (i >= n // 2), 1.0).otherwise(w)


def tiled(cells: DataFrame, tile: int, stride: int, height: int, width: int) -> DataFrame:
    """A row for each tile that holds the cell, with ``tr``, ``tc`` (the tile's start) and its blend weight ``w``."""
    def starts(place: str, size: int) -> Column:
        """The few starts around a place are reckoned from it: a list of all would grow with the grid, for every cell."""
        last, x = max(0, size - tile), F.col(place).cast("long")
        low = F.greatest(F.lit(0), F.floor((x - tile) / stride) + 1)
        high = F.least(F.floor(x / stride), F.lit((last - 1) // stride))  # of those before the last one, which is flush with the end
        before = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
        return F.explode(F.concat(before, F.when((x >= last) & (x < last + tile), F.array(F.lit(last).cast("long"))).otherwise(F.array().cast("array<bigint>"))))

    out = cells.withColumn("tr", starts("r", height)).withColumn("tc", starts("c", width))
    wr = taper(F.col("r") - F.col("tr"), tile, F.col("tr") == 0, F.col("tr") + tile >= height)
    wc = taper(F.col("c") - F.col("tc"), tile, F.col("tc") == 0, F.col("tc") + tile >= width)
    return out.withColumn("w", wr * wc + 1e-6)


def blended(tiles: DataFrame, value: str) -> DataFrame:
    return tiles.groupBy("scene", "r", "c").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def otsu(values: DataFrame, value: str, by: str = "scene") -> DataFrame:
    """The threshold (values up to it are the lower class) of largest variance between classes; of ties the lowest."""
    counts = values.groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy(by).orderBy("v"), Window.partitionBy(by)
    sums = counts.select(
        by, "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s")
    ).where("n0 < n")
    n0, n1 = F.col("n0").cast("double"), (F.col("n") - F.col("n0")).cast("double")
    gap = F.col("s0") / n0 - (F.col("s") - F.col("s0")) / n1
    return sums.withColumn("between", n0 * n1 * gap * gap).groupBy(by).agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def seam_ratio(cells: DataFrame, value: str, borders: list[int]) -> DataFrame:
    """Mean step across the tile borders against that elsewhere, over both directions."""
    parts = []
    for d in ("c", "r"):
        place = AXES[d][1]
        step = F.abs(F.col(value) - F.lag(value).over(along(d)))
        parts.append(cells.select("scene", step.alias("step"), F.col(place).isin(borders).alias("seam")).where("step IS NOT NULL"))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("scene").agg((F.avg(F.when(F.col("seam"), F.col("step"))) / F.avg(F.when(~F.col("seam"), F.col("step")))).alias("ratio"))
