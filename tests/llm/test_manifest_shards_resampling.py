"""Merkle manifest, sharding and importance resampling, against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import merkle, queries, resampling, sharding

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree string, row string"
ODD = [
    (7, "one\ntwo", "en", "b", 7), (3, "", "en", "a", 0), (None, None, None, None, None), (3, "", "en", "a", 0), (9, "été Zwei zwei", None, "b", 12),
    (4, "long " * 50_000, "en", "a", 250_000), (5, "one\ntwo", "en", "", 7), (None, "x", "de", "b", 1), (8, "ONE\nTWO", "en", "ä", 7),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], COLUMNS)


def many(n, sources):
    return [(k, f"text {k % 17}\nline {k * k % 23}", "en", f"s{k % sources}" if k % 3 else "s0", k) for k in range(n)]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def naive_manifest(rows, arity=3):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
        return out

    def beside(tree, at):
        left_right = []
        for level in tree[:-1]:
            run, place = level[at // arity * arity : at // arity * arity + arity], at % arity
            left_right.append((run[:place], run[place + 1 :]))
            at //= arity
        return left_right

    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    upper = levels([trees[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for at, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = beside(trees[s], at) + beside(upper, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            end = leaf(r, text)
            for left, right in way:
                end = sha("".join([*left, end, *right]))
            proof = sha("".join(x for left, right in way for x in [*left, *right]))
            found.append((r[0], h, trees[s][-1][0], upper[-1][0], proof, end, end == upper[-1][0]))
    return sorted(found, key=repr)


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


@pytest.mark.parametrize("rows", [ODD, ODD[:1], many(100, 3), many(10, 7)])
def test_manifest_equals_loops(spark, rows):
    found = merkle.manifest(frame(spark, rows), tampered())
    assert sorted(map(tuple, found.collect()), key=repr) == naive_manifest(rows)


def test_manifest_climbs_in_rounds_whatever_the_split(spark, monkeypatch):
    """Small blocks, so that tasks leave open ones and trees take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = many(300, 4)
        found = merkle.manifest(frame(spark, rows), tampered())
        assert sorted(map(tuple, found.collect()), key=repr) == naive_manifest(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_block_held_back_joins_the_frontier(monkeypatch):
    """Nodes in any order, and no room: what is given up early still reaches the same links in later rounds."""
    monkeypatch.setattr(merkle, "HELD", 2)
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(9)]
    block = merkle.Block()
    block.rows = [(0, 9, 0, k, leaves[k]) for k in (4, 0, 3, 8, 5)]
    found = {row[3]: row[5:] for row in block.climbed(9, 3)}
    middle = merkle.parent_digest(leaves[3:6])
    assert found[4] == (leaves[3] + leaves[5], 1, 1, middle, False)
    assert found[0] == (b"", 0, 0, leaves[0], False)


def test_manifest_of_nothing_and_of_untouched_rows(spark):
    assert merkle.manifest(frame(spark, ODD).limit(0)).count() == 0
    assert merkle.manifest(frame(spark, ODD)).where("NOT verified").count() == 0


def naive_shards(rows, shards=8, whole=0.02):
    body = lambda r: (r[1] or "").encode()
    order = sorted(rows, key=lambda r: (hashlib.sha256(body(r)).digest(), r[0] is not None, r[0] or 0))
    starts, at = [], 0
    for r in order:
        starts.append(at)
        at += len(body(r)) + 1
    cuts = []
    for k in range(1, shards):
        t = at * k // shards
        i = max(j for j, s in enumerate(starts) if s <= t)
        same = [j for j, r in enumerate(order) if body(r) == body(order[i])]
        lo, hi = starts[same[0]], starts[same[-1]] + len(body(order[i])) + 1
        cuts.append((lo if t - lo <= hi - t else hi) if hi - lo <= whole * at / shards else t)
    seen, found = Counter(), []
    for r, s in zip(order, starts, strict=True):
        shard = sum(e <= s for e in cuts)
        found.append((r[0], len(body(r)) + 1, zlib.crc32(body(r)), "bytes", shard, seen[shard], None))
        seen[shard] += 1
    return sorted(found, key=repr)


@pytest.mark.parametrize("rows", [ODD, ODD[:1], many(500, 3), [(k, "same", "en", "s", 4) for k in range(40)]])
def test_shards_equal_loops(spark, rows):
    found = sharding.shard(frame(spark, rows))
    assert sorted(map(tuple, found.collect()), key=repr) == naive_shards(rows)


def test_shards_keep_small_groups_whole_and_cut_large_ones(spark):
    rows = [(k, f"text number {k // 4}", "en", "s", 1) for k in range(8_000)] + [(k, "copied " * 3, "en", "s", 1) for k in range(8_000, 12_000)]
    found = sharding.shard(frame(spark, rows)).join(frame(spark, rows).select("doc_id", "text"), "doc_id")
    sizes = {x.shard: x.n for x in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())
    spread = {x.text: x.n for x in found.groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()}
    assert spread.pop("copied " * 3) > 1 and set(spread.values()) == {1}


def test_shards_of_nothing(spark):
    assert sharding.shard(frame(spark, ODD).limit(0)).count() == 0


def naive_resampling(rows, target, low, high, buckets, percent, least, seed):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    found = []
    for r in rows:
        g = grams(r[1])
        weight, score = sum(gain(bucket(x)) for x in g), None
        if r[0] is not None:
            h = int(sha(f"{seed}:{r[0]}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([r[0], len(words(r[1])), len(g), weight, score, None])
    taking = sorted((x for x in found if x[1] >= least and x[4] is not None), key=lambda x: (-x[4], x[0], x[2]))
    for k, x in enumerate(taking[: percent * len(taking) // 100], 1):
        x[5] = k
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize(("low", "high", "buckets"), [(1, 1, 10_000), (1, 3, 50), (2, 2, 7)])
def test_resampling_equals_loops(spark, monkeypatch, low, high, buckets):
    monkeypatch.setattr(resampling, "SLICE", 400)  # several slices, so words get their ids from the dictionary
    rows = [*ODD[:5], *ODD[6:], *[(100 + k, " ".join(f"Wort{(k * j) % 31}" for j in range(k % 40)), "de", "s", 1) for k in range(60)]]
    target = ["wort3 wort6, WORT9!", "", None, "zwei été zwei"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame(spark, rows), goal, percent=25, least_words=5, seed=11, low=low, high=high, buckets=buckets)
    assert sorted(map(tuple, found.collect()), key=repr) == naive_resampling(rows, target, low, high, buckets, 25, 5, 11)


@pytest.mark.parametrize(("low", "high"), [(1, 1), (1, 2)])
def test_no_row_holds_a_slice(spark, low, high):
    """Words and n-grams of a slice lie PART to a row and documents one to a row, so executors hold no slice in a row."""
    rows = [(k, " ".join(f"w{(k * 3_000 + j) % 9_500}" for j in range(4_000)), "en", "s", 1) for k in range(5)]
    found = resampling.sliced(frame(spark, rows), low, high, "doc_id", "text", "test-slices").collect()
    held = {name: [len(r[name]) for r in found if r[name] is not None] for name in ("words", "grams", "held")}
    assert len({r.slice for r in found}) < len(rows) and max(held["words"] + held["grams"]) <= resampling.PART < sum(held["words"])
    assert len(held["held"]) == len(rows) and max(held["held"]) <= 4_000 * (high - low + 1)
    goal = spark.createDataFrame([("w1 w2 w9000 W9001",)], "text string")
    drawn = resampling.resample(frame(spark, rows), goal, percent=50, least_words=1, seed=7, low=low, high=high, buckets=900)
    assert sorted(map(tuple, drawn.collect()), key=repr) == naive_resampling(rows, ["w1 w2 w9000 W9001"], low, high, 900, 50, 1, 7)


def test_resampling_reads_long_texts_and_empty_tables(spark):
    goal = spark.createDataFrame([("long",)], "text string")
    found = {x.doc_id: x for x in resampling.resample(frame(spark, ODD), goal, percent=100, least_words=1).collect()}
    assert found[4].n_features == 50_000 and found[3].weight == 0
    assert resampling.resample(frame(spark, ODD).limit(0), goal).count() == 0
    assert resampling.resample(frame(spark, ODD), goal.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_sharding", "op13_resampling"])
def test_query_equals_sql(spark, duck, sf_dir, name):
    found, wanted = queries.QUERIES[name](spark, sf_dir), duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(wanted.fetchall(), key=repr)
