"""Exact dedup on an extendible-hash index kept in shared files; DataFrame operations only.

Texts are equal when identical after lower-casing A-Z only.  Every text gets a 64-bit key, and the keys go into an
extendible-hash index: the low bits of a key pick a slot of a directory, which doubles while a bucket holds more than
``capacity`` keys, so a bucket's local depth says how many bits it really uses.  Buckets live in shared files sorted by
bucket and key, each written by the owner task of a range.

Rows find each other through the directory alone: a row's slot names its bucket, and only what lies in that bucket under
the row's key is compared with it.  A key that the index holds for one row is a group of its own; the rows of other
keys are chained in their bucket and told apart by their bytes, and only their texts move.

Skew: rows are folded on the map side before every shuffle of keys or texts, so a text that makes up a third of the
rows reaches its bucket as one row per map task.  The way back is a join of narrow rows (id, bucket, key, digest), whose
hot keys adaptive execution splits.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is that, and much faster, where every character is one byte."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def _low_bits(depth: Column) -> Column:
    """A mask of the lowest ``depth`` bits."""
    return F.when(depth > 63, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")) - 1)


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, list[int]]:
    """The directory of distinct ``key`` values, and the depths that its slots are given at.

    Rows are depth, slot (the low ``depth`` bits of a key), bucket and local_depth; slots without a key are left out.
    No bucket holds more than ``capacity`` keys.  A round counts the keys by slot at
    one depth, and sums the counts up the levels: a bucket that holds more than ``capacity`` keys is split by one more
    bit.  The first depth is what an even spread needs; keys of slots that are overfull even there go into another
    round, some bits deeper, until all 64 bits are used.
    """
    rest, low, found, used = keys, 0, None, []
    depth = min(64, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))) + 1)
    while True:
        used.append(depth)
        slotted = rest.withColumn("slot", F.col("key").bitwiseAND(_low_bits(F.lit(depth))))
        counted = slotted.groupBy("slot").agg(F.count("*").alias("n"))
        levels = counted.select("slot", "n", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("level"))
        levels = levels.withColumn("prefix", F.col("slot").bitwiseAND(_low_bits(F.col("level"))))
        overfull = levels.groupBy("level", "prefix").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
        deep = levels.join(overfull, ["level", "prefix"], "left").groupBy("slot").agg(F.max(F.when(F.col("held") > 0, F.col("level") + 1)).alias("deep"))
        depths = materialise(deep.select("slot", F.coalesce("deep", F.lit(low)).alias("local_depth")), "op10-directory")
        last = depth == 64
        full = depths if last else depths.where(F.col("local_depth") <= depth)
        local = F.least("local_depth", F.lit(64))
        closed = full.select(F.lit(depth).alias("depth"), "slot", F.col("slot").bitwiseAND(_low_bits(local)).alias("bucket"), local.alias("local_depth"))
        found = closed if found is None else found.unionByName(closed)
        overflow = depths.where(F.col("local_depth") > depth)
        if last or not overflow.limit(1).count():
            return found, used
        rest = materialise(slotted.join(overflow, "slot", "left_semi").select("key"), "op10-overfull")
        low, depth = depth + 1, min(64, depth + 8)


def lookup(rows: DataFrame, slots: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` with the bucket and local_depth that the directory gives for their ``key``.  A row whose slot the
    directory does not hold finds nothing and is left out."""
    at = rows.withColumn("depth", F.lit(depths[0]) if len(depths) == 1 else F.explode(F.array(*map(F.lit, depths))))
    return at.withColumn("slot", F.col("key").bitwiseAND(_low_bits(F.col("depth")))).join(slots, ["depth", "slot"]).drop("depth", "slot")


def probe(rows: DataFrame, held: DataFrame, slots: DataFrame, depths: list[int]) -> DataFrame:
    """``rows`` beside what ``held`` has for their key in the bucket that the directory sends them to."""
    return lookup(rows, slots, depths).drop("local_depth").join(held, ["bucket", "key"])


def exact_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = 4096, owned: int = 64, bound: int = 1_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth.

    Null text counts as empty, and empty texts are equal.  Of a group the largest id stays; null ids count in
    group_size but stay only in a group that has no other (keep_id is then null, and kept is false).  Rows repeated
    with one id each get a row.  Texts of any length are hashed and compared whole.  Other columns of ``docs`` are not
    read.  An empty table gives an empty result.  An owner task writes about ``owned`` buckets of the index.  Up to
    ``bound`` keys of several rows are sent to the tasks that look rows up; beyond it, texts meet them in a shuffle.
    """
    norm = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc).alias("doc_id"), norm.alias("norm"), F.xxhash64(norm).alias("key"))
    entries = materialise(rows.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "op10-entries")
    keys = materialise(entries.groupBy("key").agg(F.count("*").alias("rows"), F.max("doc_id").alias("keep_id")), "op10-keys")
    slots, depths = directory(keys.select("key"), capacity)
    owners = max(1, math.ceil(slots.select("bucket").distinct().count() / owned))
    index = materialise(lookup(keys, slots, depths).repartitionByRange(owners, "bucket", "key").sortWithinPartitions("bucket", "key"), "op10-index")

    several = index.where("rows > 1").select("bucket", "key", "local_depth")
    several = F.broadcast(several) if several.count() <= bound else several
    # Grouping by the text itself inside a bucket chains what collides on a key, and compares its bytes.
    chained = probe(rows, several, slots, depths).groupBy("bucket", "key", "local_depth", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    told = materialise(chained.select("bucket", "key", "local_depth", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), "op10-chains")
    alone = index.where("rows = 1").select("bucket", "key", "local_depth", F.lit(None).cast("string").alias("sha"), "keep_id", F.lit(1).cast("long").alias("group_size"))
    return (
        probe(entries, alone.unionByName(told), slots, depths)
        .where(F.col("sha").isNull() | (F.col("sha") == F.col("text_sha256")))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            "text_sha256",
            "bucket",
            "local_depth",
        )
    )
