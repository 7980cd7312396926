"""Grids by strips of rows, pointers by ranges of nodes: what can be settled inside one is settled in its task, and only
what crosses a border goes on between tasks.

A strip holds a bounded number of cells of one scene.  Rounds are as many as the strips that a way crosses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import settle

CELLS, FAN = 32_768, 64


def rows_of(width: int) -> int:
    return max(2, CELLS // width)


def with_strips(cells: DataFrame, width: int) -> DataFrame:
    return cells.withColumn("strip", F.expr(f"r div {rows_of(width)}"))


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _unite() -> Callable:
    """Made here, so that it goes to the executors with the task that calls it."""

    def unite(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest member of each of n members' set, where a and b are linked."""
        top = np.arange(n)
        while True:
            x, y = top[a], top[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            apart = low < high
            if not apart.any():
                return top
            a, b = a[apart], b[apart]
            np.minimum.at(top, high[apart], low[apart])
            while (far := top[top]).tobytes() != top.tobytes():
                top = far

    return unite


def labelled(cells: DataFrame, mask: str, width: int, diagonal: bool, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Components of the mask: its cells with their label, the component's smallest r * width + c, and the cells beside it
    (label null); both scene, r, c, label and what is to be kept."""
    rows, unite = rows_of(width), _unite()
    ways = [(0, 1), (1, 0), *([(1, -1), (1, 1)] if diagonal else [])]

    def local(table: pa.Table) -> pa.Table:
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        at = np.flatnonzero(table.column("inside").to_numpy(zero_copy_only=False))
        at = at[np.lexsort((c[at], r[at]))]
        place = np.full((rows + 1, width + 2), -1, np.int64)
        place[r[at] % rows, c[at] + 1] = np.arange(len(at))
        here, links = place[:-1, 1:-1], []
        for dr, dc in ways:
            there = place[dr : rows + dr, 1 + dc : width + 1 + dc]
            both = (here >= 0) & (there >= 0)
            links.append((here[both], there[both]))
        top = unite(len(at), *(np.concatenate(x) for x in zip(*links, strict=True)))
        label = np.zeros(len(r), np.int64)
        label[at] = (r[at] * width + c[at])[top]
        known = np.zeros(len(r), bool)
        known[at] = True
        return table.drop_columns(["inside", "strip"]).append_column("label", pa.array(label, mask=~known))

    laid = with_strips(cells.select("scene", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), *keep, F.coalesce(mask, F.lit(False)).alias("inside")), width)
    schema = T.StructType([*_fields(laid, "scene", "r", "c", *keep), *_longs("label")])
    found = settle(laid.groupBy("scene", "strip").applyInArrow(local, schema), "strip-labels")
    inside, beside = found.where("label IS NOT NULL"), found.where("label IS NULL")
    low = inside.where((F.col("r") % rows == 0) & (F.col("r") > 0)).select("scene", F.expr(f"r div {rows}").alias("k"), "c", F.col("label").alias("b"))
    near = F.explode(F.array(*[F.col("c") + d for d in ((-1, 0, 1) if diagonal else (0,))]))
    high = inside.where(F.col("r") % rows == rows - 1).select("scene", F.expr(f"r div {rows} + 1").alias("k"), near.alias("c"), F.col("label").alias("a"))
    links = settle(high.join(low, ["scene", "k", "c"]).select("scene", "k", "a", "b").distinct(), "strip-links")
    up, span = None, FAN
    while links.limit(1).count():
        # Borders inside a run of strips are settled in its task; those between runs go on to longer runs.
        def joined(table: pa.Table) -> pa.Table:
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            top = unite(len(names), back[: len(a)], back[len(a) :])
            moved = top < np.arange(len(names))
            scene = pa.chunked_array([table.column("scene").combine_chunks().slice(0, 1).take(pa.array(np.zeros(int(moved.sum()), np.int64)))], table.schema.field("scene").type)
            return pa.table({"scene": scene, "label": names[moved], "up": names[top[moved]]})

        runs = links.where(F.col("k") % span != 0).withColumn("run", F.expr(f"k div {span}"))
        new = settle(runs.groupBy("scene", "run").applyInArrow(joined, T.StructType([*_fields(links, "scene"), *_longs("label", "up")])), "strip-runs")
        rest = links.where(F.col("k") % span == 0)
        for x in ("a", "b"):
            rest = rest.join(new.select("scene", F.col("label").alias(x), F.col("up").alias("to")), ["scene", x], "left").withColumn(x, F.coalesce("to", x)).drop("to")
        if up is not None:
            on = new.select("scene", F.col("label").alias("up"), F.col("up").alias("to"))
            new = up.join(on, ["scene", "up"], "left").select("scene", "label", F.coalesce("to", "up").alias("up")).unionByName(new)
        up, links, span = settle(new, "strip-up"), settle(rest.where("a <> b").distinct(), "strip-links"), span * FAN
    if up is not None:
        inside = inside.join(up, ["scene", "label"], "left").withColumn("label", F.coalesce("up", "label")).select(found.columns)
    return inside, beside


def by_halo(cells: DataFrame, width: int, value: T.DataType, solve: Callable, more: list[T.StructField], label: str) -> DataFrame:
    """scene, r, c, value and more: what ``solve`` finds for a strip's cells, given the values in the rows on either side.

    ``solve`` gets the strip's table, and r, c, value of the rows beside it as far as they are known, and returns an array of
    values and a list of arrays of more, masked where there is none.  Values must fall from round to round, to a limit
    that does not depend on the order.  Only border rows are written, until they stay."""
    rows = rows_of(width)
    laid = settle(with_strips(cells.withColumns({x: F.col(x).cast("long") for x in ("r", "c")}), width), label)
    beside = T.StructType([*_fields(laid, "scene"), *_longs("strip", "r", "c"), T.StructField("value", value)])
    whole = T.StructType([*_fields(laid, "scene"), *_longs("r", "c"), T.StructField("value", value), *more])

    def run(border: bool) -> Callable:
        def task(table: pa.Table, halo: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({n: pa.array([], t) for n, t in kinds[border]})
            found, others = solve(table, *(halo.column(n).to_numpy() for n in ("r", "c", "value")))
            out = {"scene": table.column("scene"), "r": table.column("r"), "c": table.column("c"), "value": pa.array(found.filled(0), mask=np.ma.getmaskarray(found))}
            if not border:
                return pa.table(out | {f: pa.array(x.filled(0), mask=np.ma.getmaskarray(x)) for f, x in zip(names, others, strict=True)})
            r = table.column("r").to_numpy()
            parts = []
            for at, way in ((0, -1), (rows - 1, 1)):
                mine = pa.array(np.flatnonzero((r % rows == at) & ~np.ma.getmaskarray(found)))
                part = pa.table(out).take(mine)
                parts.append(part.append_column("strip", pa.array(part.column("r").to_numpy() // rows + way)).select(["scene", "strip", "r", "c", "value"]))
            return pa.concat_tables(parts)

        return task

    from pyspark.sql.pandas.types import to_arrow_type

    names = [f.name for f in more]
    kinds = {b: [(f.name, to_arrow_type(f.dataType)) for f in s.fields] for b, s in ((True, beside), (False, whole))}
    both = lambda known, border: laid.groupBy("scene", "strip").cogroup(known.groupBy("scene", "strip")).applyInArrow(run(border), beside if border else whole)
    known, before = laid.sparkSession.createDataFrame([], beside), None
    while True:
        known = settle(both(known, True), f"{label}-borders")
        now = known.agg(F.sum(F.xxhash64("scene", "r", "c", "value").cast("decimal(38,0)")), F.count("*")).first()
        if now == before or not now[1]:
            return settle(both(known, False), f"{label}-found")
        before = now
