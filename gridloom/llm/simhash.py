"""SimHash near-dedup by tiled exact comparison.

Documents with one fingerprint are folded first.  A fingerprint's tile is the tuple of population counts of its
quarters: two fingerprints within ``radius`` bits have tiles whose counts differ by no more than ``radius`` in all,
so every other pair of tiles is skipped.  What is left is compared exactly, block against block, by numpy exclusive
or and bit counts.  Tiles are cut into blocks of bounded size, so no task holds a whole tile.  A unit of work returns
not its pairs but a spanning forest of them; connected components then grow by star contraction in Spark.

``similar_groups`` finds sets of shingles of a given similarity by wide fingerprints, in the same way: tiles, blocks,
exclusive or, forests.  The radius that this needs is so wide that quarters' counts would skip few tiles, so there a tile is
a class of population counts and one of set sizes; the pairs that are left have their whole sets compared.
"""

from __future__ import annotations

import math
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, ship

PARTS, BITS = 4, 16
SIDE = BITS + 1


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """Lower-case A-Z, take words between ASCII white space, hash each shingle, and vote on every bit."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    hashes = np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of every row; null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            out = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def tile_of(fp: np.ndarray) -> np.ndarray:
    """The tile's number: population counts of the quarters, as digits."""
    x, tile = fp.view(np.uint64), np.zeros(len(fp), np.int64)
    for k in range(PARTS):
        tile = tile * SIDE + np.bitwise_count(x >> np.uint64(BITS * k) & np.uint64(2**BITS - 1))
    return tile


def near_tiles(radius: int) -> list[tuple[int, ...]]:
    """Steps between tiles that can hold a pair, one of each two opposite ones."""
    steps = product(range(-radius, radius + 1), repeat=PARTS)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]


def linked(left: np.ndarray, right: np.ndarray, radius: int, cells: int = 1 << 20):
    """Places (i, j) of the fingerprints of two blocks within ``radius`` bits, some rows of the left at a time."""
    step = max(1, cells // max(1, len(right)))
    for k in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[k : k + step, None] ^ right[None, :]) <= radius)
        yield k + i, j


def forest(left: np.ndarray, right: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two blocks of nodes; ``pairs`` gives places of linked nodes."""
    nodes = np.unique(np.concatenate([left, right]))
    at_left, at_right = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    label = np.arange(len(nodes))
    for i, j in pairs:
        a, b = at_left[i], at_right[j]
        while len(a):
            la, lb = label[a], label[b]
            a, b, la, lb = (x[la != lb] for x in (a, b, la, lb))
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def links(distinct: DataFrame, radius: int, left_block: int = 8192, right_block: int = 65536) -> DataFrame:
    """Edges (u, v), v < u, whose components are those of all pairs within ``radius`` bits."""
    # Population counts of four quarters have 17 ** 4 values: this table is bounded whatever the input.
    tile_expr = " + ".join(f"bit_count(shiftrightunsigned(fp, {BITS * k}) & {2**BITS - 1}) * {SIDE ** (PARTS - 1 - k)}" for k in range(PARTS))
    counted = distinct.groupBy(F.expr(f"bigint({tile_expr})").alias("tile")).agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros(SIDE**PARTS, np.int64)
    counts[counted.tile.to_numpy(np.int64)] = counted.n.to_numpy()
    steps = near_tiles(radius)
    digit = SIDE ** np.arange(PARTS - 1, -1, -1)
    filled = np.flatnonzero(counts)
    pool = np.zeros_like(counts)  # of each tile: the fingerprints that it is compared with

    def moved(tile: np.ndarray, step: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Which tiles have a neighbour at this step, and the neighbours."""
        digits = tile[:, None] // digit % SIDE + np.array(step)
        ok = ((digits >= 0) & (digits < SIDE)).all(1)
        return ok, (digits[ok] * digit).sum(1)

    for s in steps:
        ok, other = moved(filled, s)
        np.add.at(pool, filled[ok], counts[other])
    blocks, pools = -(-counts // left_block), -(-pool // right_block)
    sent = distinct.sparkSession.sparkContext.broadcast((blocks, pools))

    def spread(batches):
        blocks, pools = sent.value
        for batch in batches:
            fp = batch.column(0).to_numpy()
            tile = tile_of(fp)
            salt = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64)

            def units(home, side, row, kept, free):
                """A row for each unit of its home tile: its own block of one kind, and all of the other."""
                n = free[home]
                row, home = np.repeat(row, n), np.repeat(home, n)
                other = np.arange(len(home)) - np.repeat(np.cumsum(n) - n, n)
                own = salt[row] % kept[home]
                a, c = (own, other) if side == 0 else (other, own)
                return pa.RecordBatch.from_arrays(
                    [pa.array(home), pa.array(a), pa.array(c), pa.array(np.full(len(home), side, np.int8)), pa.array(fp[row])], ["tile", "a", "c", "side", "fp"]
                )

            rows = np.arange(len(fp))
            yield units(tile, 0, rows, blocks, pools)
            for s in steps:
                ok, home = moved(tile, tuple(-x for x in s))
                row = rows[ok]
                there = blocks[home] > 0
                yield units(home[there], 1, row[there], pools, blocks)

    def compare(t: pa.Table) -> pa.Table:
        side, fp = t.column("side").to_numpy(), t.column("fp").to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        u, v = forest(left, right, linked(left.view(np.uint64), right.view(np.uint64), radius))
        return pa.table({"u": u, "v": v})

    spread_out = map_arrow(distinct.select("fp"), spread, "tile long, a long, c long, side byte, fp long")
    return spread_out.groupBy("tile", "a", "c").applyInArrow(compare, "u long, v long").where("u != v")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; without words, none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words)))
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)], np.uint64))


def digest(found: np.ndarray) -> int:
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(found.tobytes(), 1)], np.uint64).view(np.int64)[0])


WIDE = 4  # 64-bit words of a wide fingerprint
_own = np.random.default_rng(20240611)
TURNS = _own.integers(0, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SMALL, MORE = 6, 16  # votes of so few shingles tie often: they may differ in so many bits more


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """A vote of the set's shingles on each of 64 * WIDE bits, as in ``fingerprint``."""
    votes = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(found), 1 << 14):
        bits = stirred(found[k : k + (1 << 14), None] * TURNS)
        votes += np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits(votes * 2 > len(found), bitorder="little").view(np.uint64)


def reach(n: np.ndarray, radius: int) -> np.ndarray:
    """In how many bits sets may differ of which the larger has ``n`` shingles."""
    return np.where(n <= SMALL, radius + MORE, radius)


def linked_wide(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, radius: int, similarity: float, cells: int = 1 << 17):
    """Places (i, j) of wide fingerprints of two blocks, both in ascending order of their set sizes ``n`` and ``m``, within
    ``radius`` bits, where the right set is as large or larger, and not too large for the similarity."""
    low, high = np.searchsorted(m, n, side="left"), np.searchsorted(m, n / similarity + 1e-9, side="right")
    k = 0
    while k < len(n):
        to = k + max(1, cells // max(1, int(high[k] - low[k])))
        a, b = int(low[k]), int(high[min(to, len(n)) - 1])
        to = min(to, k + max(1, 4 * cells // max(1, b - a)), len(n))
        b = int(high[to - 1])
        if b > a:
            bits = np.zeros((to - k, b - a), np.uint16)
            for w in range(WIDE):
                bits += np.bitwise_count(left[k:to, w, None] ^ right[None, a:b, w])
            i, j = np.nonzero(bits <= reach(m[a:b], radius))
            i, j = i + k, j + a
            inside = (j >= low[i]) & (j < high[i])
            yield i[inside], j[inside]
        k = to


def wide_links(sets: DataFrame, radius: int, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) between nodes of ``sets`` (node, n, fp, ones) whose components are those of all pairs within ``radius`` bits
    whose sizes allow the similarity.

    A tile is a class of sizes and one of population counts, so wide that such pairs lie in one tile or in adjacent ones.
    A tile's sets meet those of its own class of sizes and of the next, in blocks of about ``block`` sets a side.
    """
    spark = sets.sparkSession
    tiled = sets.withColumns({"size": F.floor(F.log("n") / (math.log(1 / similarity) + 1e-9)), "counts": F.floor(F.col("ones") / (radius + MORE + 1))})
    held = {(r["size"], r["counts"]): r["sets"] for r in tiled.groupBy("size", "counts").agg(F.count("*").alias("sets")).collect()}  # some hundred tiles, whatever the input
    plan = []
    for size, counts in held:
        near = [t for t in product((size, size + 1), (counts - 1, counts, counts + 1)) if t in held]
        blocks, pools = (-(-n // block) for n in (held[size, counts], sum(held[t] for t in near)))
        plan += [(size, counts, size, counts, 0, blocks, pools)] + [(*t, size, counts, 1, pools, blocks) for t in near]
    steps = spark.createDataFrame(plan, "size long, counts long, home_size long, home_counts long, side int, own long, other long")
    met = tiled.join(F.broadcast(steps), ["size", "counts"]).withColumn("own", F.pmod(F.xxhash64("node"), "own")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1)))
    first = F.col("side") == 0
    units = met.select("home_size", "home_counts", F.when(first, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("c"), "side", "node", "n", "fp")

    def compare(t: pa.Table) -> pa.Table:
        side, node, n = (t.column(c).to_numpy() for c in ("side", "node", "n"))
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)
        left, right = (k[np.argsort(n[k], kind="stable")] for k in (np.flatnonzero(side == s) for s in (0, 1)))
        pairs = linked_wide(fp[left], fp[right], n[left], n[right], radius, similarity)
        u, v = forest(node[left], node[right], pairs)
        return pa.table({"u": u, "v": v})

    ship(spark)
    return units.groupBy("home_size", "home_counts", "a", "c").applyInArrow(compare, "u long, v long").where("u != v")


def linked_sets(node: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, radius: int, similarity: float):
    """Edges of a spanning forest, between rows of different labels, of the pairs of a ``left`` row and any row whose
    sets have the similarity.  Fingerprints choose what is compared, and what hangs together already is not."""
    size = np.array([len(x) for x in sets])
    edges = np.append(0, np.cumsum(size))
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(ids) + 1, bool), label.copy()
    out = []
    for i in left.tolist():
        near = (np.bitwise_count(prints ^ prints[i]).sum(1, dtype=np.int32) <= reach(np.maximum(size, size[i]), radius)) & (label != label[i])
        near &= np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9
        own = ids[edges[i] : edges[i + 1]]
        mark[own] = True
        for j in np.flatnonzero(near).tolist():
            if label[j] == label[i]:
                continue
            both = np.count_nonzero(mark[ids[edges[j] : edges[j + 1]]])
            if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
        mark[own] = False
    return out


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, slack: int = 24, tile: int = 32_768, block: int = 4096,
    block_bytes: int = 1 << 26, doc: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, component_id for every row, for sets of shingles of a Jaccard ``similarity`` or more.

    Candidates are all pairs whose wide SimHash fingerprints differ in no more bits than the similarity lets differ on
    average and ``slack`` more, four standard deviations, and whose sizes allow the similarity.  ``wide_links`` compares
    tiles of them exactly, in blocks of ``tile`` fingerprints a side, and returns spanning forests, whose components hold
    all candidates.  Inside these, in
    blocks of ``block`` sets and about ``block_bytes`` of shingles, the whole sets are compared, and a block returns a
    spanning forest of the true links; sets outside the largest group of a component that fills several blocks then meet
    the other blocks.

    component_id is the smallest id reachable.  Equal sets fold, by a 64-bit digest.  Null and wordless texts form one
    group; null ids link like any other but name no group that has another.  Texts of any length count whole.  Other
    columns are not read; an empty table gives no rows.
    """
    radius = round(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi) + slack
    held_rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for k in range(0, len(texts), 1000):
                sets = [shingle_set(t or b"", shingle) for t in texts[k : k + 1000]]
                prints = [wide_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, len(sets)), batch.column(2).slice(k, len(sets)), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([int(np.bitwise_count(p).sum()) for p in prints], pa.int32()),
                    ],
                    ["doc_id", "key", "node", "n", "fp", "ones"],
                )

    each = materialise(map_arrow(held_rows, run, "doc_id long, key long, node long, n long, fp binary, ones int"), "op5-sets")
    # A set's text stands for it; rows that repeat the text or the set fold.
    folded = materialise(each.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.count("*").alias("copies")), "op5-folded")
    many = materialise(folded.where("copies > 1").select("node"), "op5-many")
    columns = ["node", "n", "fp", "ones"]
    lone = each.join(many, "node", "left_anti").where("n > 0").select(columns)
    repeated = each.join(many, "node", "left_semi").where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in columns[1:]])
    sets = lone.unionByName(repeated)
    roots = materialise(components(wide_links(sets, radius, similarity, tile), "op5-candidates"), "op5-roots")

    # Every node of a candidate component, its root included, with the component's size.
    inside = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    filled = F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / block_bytes)).cast("int")
    inside = inside.join(sets.select("node", "n", "fp"), "node")
    placed = materialise(inside.join(inside.groupBy("root").agg(filled.alias("blocks")), "root"), "op5-placed")
    piles = int(placed.agg(filled).first()[0]) + 1 if placed.limit(1).count() else 1

    def whole(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    # Only candidates' texts are read again; one of the rows that share a text will do.
    keys = materialise(folded.join(placed, "node", "left_semi").select("key"), "op5-keys")
    texts = held_rows.join(keys, "key", "left_semi").select("text")
    found = map_arrow(texts, whole, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    ready = materialise(placed.join(found, "node"), "op5-ready")

    def verify(table: pa.Table) -> pa.Table:
        """True links inside each group of a pile; ``label`` tells what hangs together before."""
        out = []
        group, node, label, side = (table.column(c).to_numpy() for c in ("group", "node", "label", "side"))
        order = np.lexsort((node, side, group))
        cut = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
        prints, shingles = table.column("fp"), table.column("shingles")
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            at = order[i:j]
            some = pa.array(at)
            fp = np.frombuffer(b"".join(prints.take(some).to_pylist()), np.uint64).reshape(-1, WIDE)
            held = [np.frombuffer(x, np.uint64) for x in shingles.take(some).to_pylist()]
            out += linked_sets(node[at], fp, held, label[at], np.flatnonzero(side[at] == 0), radius, similarity)
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    part = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    columns = ["node", "n", "fp", "shingles"]
    small = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(piles))).otherwise(F.xxhash64("root", part))
    group = F.when(F.col("blocks") == 1, F.col("root")).otherwise(F.xxhash64("root", part))
    first = ready.select(small.alias("pile"), group.alias("group"), F.lit(0).alias("side"), F.col("node").alias("label"), *columns)
    edges = materialise(first.groupBy("pile").applyInArrow(verify, "u long, v long"), "op5-true")
    true = components(edges, "op5-similar")
    # Of components that fill several blocks, the nodes outside the largest true group meet the blocks they were not in.
    large = materialise(ready.where("blocks > 1").join(true.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "op5-large")
    if large.limit(1).count():
        main = large.groupBy("root", "label").agg(F.count("*").alias("held")).groupBy("root").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
        met = large.join(F.broadcast(main) if main.count() <= 100_000 else main, "root").withColumn("part", part)
        rest = met.where("label != main")
        rests = rest.groupBy("root").agg(filled.alias("rests"))
        one, other = F.pmod(F.xxhash64("node", F.lit(1)), "rests").cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
        left = rest.join(rests, "root").withColumn("a", one).withColumn("c", F.explode(other)).select("root", "a", "c", F.lit(0).alias("side"), "label", *columns)
        right = met.join(rests, "root").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("root", "a", F.col("part").alias("c"), F.lit(1).alias("side"), "label", *columns)
        second = left.unionByName(right).withColumn("group", F.xxhash64("root", "a", "c")).withColumn("pile", F.col("group"))
        edges = materialise(edges.unionByName(second.groupBy("pile").applyInArrow(verify, "u long, v long")), "op5-all-true")
        true = components(edges, "op5-similar")
    rooted = folded.join(true, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.select("doc_id", "node").join(rooted.join(named, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (u, v) but the roots; root is the component's smallest node.

    Alternating large and small stars: every round is a group-by and a join, and is written to the shared folder.
    """

    def size(e: DataFrame):
        return e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    def turned(e: DataFrame) -> DataFrame:
        return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = materialise(turned(edges), label)
    before = size(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = turned(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(turned(small.unionByName(least.select("u", F.col("m").alias("v")))), label)
        after = size(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed long), component_id for every row; component_id is the smallest id that can be reached
    over links of at most ``radius`` bits.

    Null, empty and wordless texts have fingerprint 0 and link like any other.  A text of fewer words than a
    shingle is one shingle; one of any length votes whole.  Repeated rows and copies fold into one fingerprint.  Null ids belong to a component
    but never name one, unless it has no other.  Other columns are not read; an empty table gives an empty result.
    """
    each = materialise(fingerprints(docs, shingle, doc, text), "op5-fingerprints")
    distinct = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "op5-distinct")
    roots = components(links(distinct, radius), "op5-links")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
