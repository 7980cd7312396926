"""Contiguous shards of nearly equal size, cut from a global prefix sum of bytes.

Rows are ordered by the digest of their text, so that equal texts stand side by side, and by id.  Every partition of
that order gives one total; a prefix sum of the totals gives each partition's offset, and a running sum inside it each
row's place in the whole.  The places are cut at equal targets.  A target that falls inside a group of equal texts moves to
the group's nearer end if the group is small beside a shard; a large group is cut where the target falls.

Only ids, sizes and digests are sorted, never texts.  No row's place depends on a group being together in one task, so
copies may make up any part of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered


def edges(placed: DataFrame, shards: int, whole: float) -> list[int]:
    """Where shards 1, 2, ... begin, in bytes.  At most ``shards`` rows reach the driver."""
    total = placed.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    if not total or not targets:
        return targets
    # Target k lies in the row that ends beyond it: one row a target.
    wanted = placed.sparkSession.createDataFrame([(t,) for t in sorted(set(targets))], "target long")
    hit = placed.select("digest", "size_before", "size").join(F.broadcast(wanted), (F.col("size_before") <= F.col("target")) & (F.col("target") < F.col("size_before") + F.col("size")))
    groups = placed.join(F.broadcast(hit.select("digest").distinct()), "digest", "left_semi").groupBy("digest")
    extents = groups.agg(F.min("size_before").alias("start"), F.max(F.col("size_before") + F.col("size")).alias("stop")).collect()
    moved = []
    for t in targets:
        start, stop = next((g["start"], g["stop"]) for g in extents if g["start"] <= t < g["stop"])
        small = stop - start <= whole * total / shards
        moved.append((start if t - start <= stop - t else stop) if small else t)
    return moved


def shard(docs: DataFrame, shards: int = 8, whole: float = 0.02, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Every row starts in the shard whose target range holds its first byte, so shards differ by a row and by the
    groups of equal texts kept whole: those of at most ``whole`` of a shard's bytes, which moves an edge by half of
    that.  Null texts count as empty and equal to empty ones.  Null ids come first among equal texts; rows repeated
    with one id each get a slot.  A text longer than a shard leaves shards beside it empty.  Other columns are not
    read.  An empty table gives no row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest"), F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc("digest"), F.asc_nulls_first("doc_id"), F.asc("tie")]
    placed = materialise(numbered(materialise(rows, "op12-rows"), order, "op12-ordered", sums=("size",)), "op12-placed")
    begins = F.array(*[F.lit(e).cast("long") for e in edges(placed, shards, whole)]).cast("array<long>")
    dealt = placed.withColumn("shard", F.size(F.filter(begins, lambda e: e <= F.col("size_before"))))
    first = dealt.groupBy("shard").agg(F.min("row").alias("first"))  # a row a shard
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
