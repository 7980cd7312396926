"""Accuracy metrics and robust fits, each by one or two aggregations over any grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle

NMAD = 1.4826


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where either side does not vary, on which ``corr`` fails."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join of groups that may be null; without columns ``right`` is one row."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({k: f"{k}_right" for k in on})
    return left.join(right, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in on])).drop(*[f"{k}_right" for k in on])


def quantile(rows: DataFrame, by: list[str], value: str | Column, q: float, name: str = "q", ranges: int = 64) -> DataFrame:
    """by, name: the exact quantile of each group, between two values in proportion; nulls and NaN do not count, and a
    group of nothing else has no row.  Groups may be null.

    A sketch of bounded size cuts each group's values into ``ranges`` of about equal size, counts tell which of them hold
    the rank, and only these are moved and sorted, each on its own: no task meets a group's values, and the others
    are read but stay where they are.  Where the sketch is off, ranges are uneven and the result the same.  Edges and
    ranges are written, so the joins with them are chosen by their true size."""
    v, keys = F.col(value) if isinstance(value, str) else value, [f"g{k}" for k in range(len(by))]
    whole = rows.select(*[F.col(b).alias(g) for b, g in zip(by, keys, strict=True)], v.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    cuts = F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 16 * ranges)
    edges = settle(whole.groupBy(*keys).agg(cuts.alias("edges"), F.count("*").alias("n")).where("n > 0"), "edges")
    ranged, step = _met(whole, edges, keys).withColumn("range", F.lit(0)), ranges // 2
    while step:  # a search by halves among the edges; ``ranges`` is a power of two
        ranged = ranged.withColumn("range", F.col("range") + F.when(F.get("edges", F.col("range") + (step - 1)) <= F.col("v"), step).otherwise(0))
        step //= 2
    ranged = ranged.select(*keys, "v", "range", (q * (F.col("n") - 1)).alias("place"))
    held = ranged.groupBy(*keys, "range").agg(F.count("*").alias("held"), F.max("place").alias("place"))
    held = held.withColumn("upto", F.sum("held").over(Window.partitionBy(*keys).orderBy("range")))
    wanted = settle(held.where((F.floor("place") < F.col("upto")) & (F.ceil("place") >= F.col("upto") - F.col("held"))).select(*keys, "range", (F.col("upto") - F.col("held")).alias("before")), "ranges")
    inside = _met(ranged, wanted, [*keys, "range"]).groupBy(*keys, "range", "v").agg(F.count("*").alias("n"), F.max("before").alias("before"), F.max("place").alias("place"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("v"))
    low, high = (F.min(F.when(F.col("upto") > f("place"), F.col("v"))) for f in (F.floor, F.ceil))
    part = F.max("place") - F.floor(F.max("place"))
    found = inside.withColumn("upto", upto).groupBy(*keys).agg((low + (high - low) * part).alias("found"), F.count("*").alias("some")).where("some > 0")
    return found.select(*[F.col(g).alias(b) for b, g in zip(by, keys, strict=True)], F.col("found").alias(name))


def accuracy(pairs: DataFrame, by: list[str], pred: str = "pred", ref: str = "ref", least: int = 10) -> DataFrame:
    """n, rmse, mae, bias, r, nmad, rmse_shift_free by group; all but n are null under ``least`` finite pairs."""
    d = (F.col(pred) - F.col(ref)).alias("d")
    finite = settle(pairs.where(F.col(pred).isNotNull() & F.col(ref).isNotNull() & ~F.isnan(pred) & ~F.isnan(ref)).select(*by, pred, ref, d), "pairs")
    median = settle(quantile(finite, by, "d", 0.5, "med"), "medians")
    # The medians are one row per group, and join by the groups' columns.
    off = F.col("d") - F.col("med")
    both = finite.join(median, by) if by else finite.crossJoin(F.broadcast(median))
    out = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg(F.abs("d")).alias("mae"), F.avg("d").alias("bias"),
        F.corr(pred, ref).alias("r"), F.sqrt(F.avg(off * off)).alias("rmse_shift_free"),
    )
    spread = quantile(both, by, F.abs(off), 0.5, "spread").withColumn("nmad", NMAD * F.col("spread"))
    out = out.join(spread, by) if by else out.crossJoin(F.broadcast(spread))
    return out.select(*by, "n", *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("rmse", "mae", "bias", "r", "nmad", "rmse_shift_free")])


def compared(surfaces: DataFrame, products: list[str], ref: str, is_object: Column) -> DataFrame:
    """accuracy() of several surfaces (columns) over all cells and over objects only: columns surface, subset."""
    long = surfaces.withColumn("object", is_object).select(
        ref, "object", F.explode(F.array(*[F.struct(F.lit(p).alias("surface"), F.col(p).alias("pred")) for p in products])).alias("s")
    )
    subset = F.explode(F.when(F.col("object"), F.array(F.lit("all"), F.lit("objects"))).otherwise(F.array(F.lit("all"))))
    return accuracy(long.select(F.col(ref).alias("ref"), "s.*", subset.alias("subset")), ["surface", "subset"])


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The lower weighted median: the smallest value up to which half of the weight lies.

    Equal values fold first, so the running sum goes over distinct values only."""
    folded = rows.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("v")
    cum = folded.select(*by, "v", F.sum("w").over(upto).alias("cw"), F.sum("w").over(whole).alias("tw"))
    return cum.where(F.col("cw") >= F.col("tw") / 2).groupBy(*by).agg(F.min("v").alias("wmedian"))


def clean_anchors(anchors: DataFrame, by: list[str], height: str = "h", spread: str = "spread", tallest: float = 120.0) -> DataFrame:
    """Drop anchors that are too tall, too spread, or (with eight left) far above the others."""
    first = anchors.where((F.col(height) <= tallest) & (F.col(spread) <= F.greatest(F.lit(6.0), 0.5 * F.col(height))))
    med = first.groupBy(*by).agg(F.median(height).alias("med"), F.count("*").alias("left"))
    dev = first.join(med, by)
    mad = dev.groupBy(*by).agg(F.median(F.abs(F.col(height) - F.col("med"))).alias("mad"))
    kept = dev.join(mad, by).where((F.col("left") < 8) | (F.col(height) <= F.col("med") + 5 * F.greatest("mad", F.lit(1.0))))
    return kept.select(anchors.columns)


def inlier_anchors(anchors: DataFrame, by: list[str], rel: str = "rel", height: str = "h", weight: str = "w") -> DataFrame:
    """The usable anchors with ``k`` (height over relative height), ``inlier`` (within three deviations of the weighted
    median of k, or a quarter of it) and ``n``, the group's usable ones."""
    ratios = anchors.where((F.col(rel) > 0.005) & (F.col(height) > 0)).withColumn("k", F.col(height) / F.col(rel))
    off = ratios.join(weighted_median(ratios, by, "k", weight), by)
    mad = off.groupBy(*by).agg(F.median(F.abs(F.col("k") - F.col("wmedian"))).alias("mad"), F.count("*").alias("n"))
    inlier = F.abs(F.col("k") - F.col("wmedian")) <= F.greatest(3 * NMAD * F.col("mad"), 0.25 * F.col("wmedian"))
    return off.join(mad, by).withColumn("inlier", inlier).drop("wmedian", "mad")


def robust_scale(anchors: DataFrame, by: list[str], rel: str = "rel", height: str = "h", weight: str = "w") -> DataFrame:
    """by, scale, inliers, n: weighted median of h / rel, again over what lies within three deviations of it."""
    kept = inlier_anchors(anchors, by, rel, height, weight).where("inlier")
    again = weighted_median(kept.select(*by, "k", weight), by, "k", weight).withColumnRenamed("wmedian", "scale")
    counts = kept.groupBy(*by).agg(F.count("*").alias("inliers"), F.max("n").alias("n"))
    return again.join(counts, by)


def leave_one_out(anchors: DataFrame, by: list[str], rel: str = "rel", height: str = "h", weight: str = "w") -> DataFrame:
    """by, loo_rmse, loo_mae: each usable anchor predicted by the weighted median of the others' ratios.

    No anchor meets another.  Without an anchor of weight w the others weigh tw - w, and the running sum falls by w from
    its ratio on.  So the median is the first ratio whose sum reaches (tw - w) / 2, if that lies below the anchor's; else the
    first that reaches (tw + w) / 2, and the one after it where that is a ratio which the anchor alone holds.  Both
    depend on the group and w only, and are found for all weights at once by a running value over the sorted sums.
    """
    rows = anchors.where((F.col(rel) > 0.005) & (F.col(height) > 0)).withColumn("k", F.col(height) / F.col(rel))
    folded = rows.groupBy(*by, "k").agg(F.sum(weight).alias("kw"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("k")
    steps = folded.select(*by, F.struct("k", "kw", F.lead("k").over(upto).alias("after")).alias("step"), F.sum("kw").over(upto).alias("cw"), F.sum("kw").over(whole).alias("tw"))
    total = steps.groupBy(*by).agg(F.max("tw").alias("tw"))
    wanted = rows.select(*by, F.col(weight).alias("own")).distinct().join(total, by)
    wanted = wanted.select(*by, "own", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), ((F.col("tw") + x * F.col("own")) / 2).alias("at")) for x in (-1, 1)])).alias("x"))
    empty = F.lit(None).cast(steps.schema["step"].dataType)
    line = steps.select(*by, F.col("cw").cast("double").alias("at"), "step", F.lit(None).cast(rows.schema[weight].dataType).alias("own"), F.lit(None).cast("int").alias("side"))
    line = line.unionByName(wanted.select(*by, F.col("x.at").cast("double").alias("at"), empty.alias("step"), "own", "x.side"))
    # From the largest sum down; of equal ones the steps come first, so a place sought meets the step that just reaches it.
    reached = F.last("step", ignorenulls=True).over(whole.orderBy(F.desc("at"), F.col("step").isNull(), F.desc("step.k")).rowsBetween(Window.unboundedPreceding, 0))
    met = line.select(*by, "own", "side", reached.alias("met")).where("side IS NOT NULL")
    sides = met.groupBy(*by, "own").agg(F.max(F.when(F.col("side") < 0, F.col("met.k"))).alias("below"), F.max(F.when(F.col("side") > 0, F.col("met"))).alias("from"))
    each = rows.join(sides.withColumnRenamed("own", weight), [*by, weight])
    alone = (F.col("from.k") == F.col("k")) & (F.col("from.kw") <= F.col(weight))
    scale = F.when(F.col("below") < F.col("k"), F.col("below")).when(alone, F.col("from.after")).otherwise(F.col("from.k"))
    error = each.select(*by, (scale * F.col(rel) - F.col(height)).alias("e"))
    return error.groupBy(*by).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("loo_rmse"), F.avg(F.abs("e")).alias("loo_mae"))


def latest_wins(anchors: DataFrame, key: list[str], priority: str, order: str) -> DataFrame:
    """One row per key: the highest priority, then the last in order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(priority), F.desc(order)))
    return anchors.withColumn("__n", n).where("__n = 1").drop("__n")


def affine(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, a, b of y = a x + b by least squares; without spread in x: 0 and the mean."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.var_pop(x).alias("v"), F.avg(y).alias("m"))
    flat = F.col("v") <= 1e-12
    return fit.select(*by, F.when(flat, 0.0).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("m")).otherwise(F.col("b")).alias("b"))


def trimmed_affine(rows: DataFrame, by: list[str], x: str, y: str, trim: float = 0.05, rounds: int = 2) -> DataFrame:
    """affine() from medians and deviations, refitted on the pairs with the smaller residuals; a slope that is not
    positive gives way to the ratio of the deviations."""
    pairs = settle(rows.select(*by, F.col(x).alias("x"), F.col(y).alias("y")), "pairs")
    off = lambda c, m: F.abs(F.col(c) - F.col(m))
    med = settle(quantile(pairs, by, "x", 0.5, "mx").join(quantile(pairs, by, "y", 0.5, "my"), by), "medians")
    left = pairs.join(med, by)
    mad = quantile(left, by, off("x", "mx"), 0.5, "dx").join(quantile(left, by, off("y", "my"), 0.5, "dy"), by).join(med, by)
    fit = mad.select(*by, F.when(F.col("dx") > 1e-9, F.col("dy") / F.col("dx")).otherwise(0.0).alias("a"), "mx", "my")
    fit = settle(fit.select(*by, "a", (F.col("my") - F.col("a") * F.col("mx")).alias("b")), "fit")
    for _ in range(rounds):
        left = pairs.join(fit, by).withColumn("res", F.abs(F.col("a") * F.col("x") + F.col("b") - F.col("y")))
        cut = settle(quantile(left, by, "res", 1 - trim, "cut"), "cut")
        kept = left.drop("a", "b").join(cut, by).where(F.col("res") <= F.col("cut"))
        fit = settle(affine(kept, by, "x", "y"), "fit")
    return fit


def plane(rows: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """by, p0, p1, p2 of z = p0 + p1 x + p2 y by least squares, from nine sums of centred values."""
    mean = rows.groupBy(*by).agg(*[F.avg(v).alias(f"m{v}") for v in (x, y, z)])
    at = rows.join(mean, by).select(*by, *[(F.col(v) - F.col(f"m{v}")).alias(v) for v in (x, y, z)])
    s = at.groupBy(*by).agg(*[F.sum(F.col(a) * F.col(b)).alias(n) for n, a, b in (("xx", x, x), ("xy", x, y), ("yy", y, y), ("xz", x, z), ("yz", y, z))]).join(mean, by)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    p1 = F.when(F.abs(det) > 1e-12, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det).otherwise(0.0)
    p2 = F.when(F.abs(det) > 1e-12, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det).otherwise(0.0)
    return s.withColumn("p1", p1).withColumn("p2", p2).select(*by, (F.col(f"m{z}") - F.col("p1") * F.col(f"m{x}") - F.col("p2") * F.col(f"m{y}")).alias("p0"), "p1", "p2")


def band_scale(blocks: DataFrame, by: list[str], detail: str, dem: str) -> DataFrame:
    """by, s, r, n: regression through the origin of one detail on another, with its correlation."""
    d, e = F.col(detail), F.col(dem)
    return blocks.groupBy(*by).agg((F.sum(d * e) / F.nullif(F.sum(d * d), F.lit(0.0))).alias("s"), correlation(detail, dem).alias("r"), F.count("*").alias("n"))


def kernel_field(anchors: DataFrame, by: list[str], height: int, width: int, scale: str = "scale", prior: float = 3.0, least: int = 12) -> DataFrame:
    """by, i, j, factor: the local scale at the nodes of a coarse grid (one for 32 cells), from a group's inliers (row,
    col, k, w, scale).  Groups of fewer than ``least`` have none.  The nodes are as many for any number of anchors, and
    the sums fold before they are shuffled."""
    rows, cols = max(2, height // 32), max(2, width // 32)
    sigma2 = 2.0 * (height * height + width * width) / 16.0
    enough = anchors.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*by)
    some = anchors.join(enough, by, "left_semi")
    for name, n in (("i", rows), ("j", cols)):
        some = some.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d2 = ((F.col("i") + 0.5) * height / rows - F.col("row")) ** 2 + ((F.col("j") + 0.5) * width / cols - F.col("col")) ** 2
    some = some.withColumn("kw", F.col("w") * F.exp(-d2 / sigma2))
    mean = F.sum(F.col("kw") * F.ln(F.col("k") / F.col(scale))) / (F.sum("kw") + prior)
    return some.groupBy(*by, "i", "j").agg(F.exp(mean).alias("factor"))
