"""Importance resampling towards a target distribution, by hashed n-grams over an integer word dictionary.

Documents are read in slices of some megabytes.  A slice tells its distinct words once, and each document as the slice's
n-grams it holds and how often.  The distinct words of all slices get ids from one dictionary; n-grams become tuples of
ids, whose counts in the source and the target are summed.  Each distinct tuple is spelled out once and hashed into a
bucket; a bucket's gain is the logarithm of its share in the target to its share in the source.  Gains go back to
tuples by a join and meet the documents of their slice in a cogroup, so text is neither kept nor read again.

No row holds a slice: words and n-grams lie ``PART`` to a row, documents one to a row, and a task gathers one slice at a
time, in Python, as flat arrays.  A word that stands everywhere is one row a slice, never one row an occurrence; joins on
words and tuples carry no hint, so adaptive execution splits frequent ones.  Only the gains, a row a bucket, are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, numbered, slices, utf8

#: Runs of ASCII digits, lower-case ASCII letters and bytes of all other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SLICE = 1 << 23  # bytes of texts that share a slice; a longer text has one to itself
PART = 1 << 12  # words or n-grams of a slice that share a row
KINDS = {
    "slice": pa.int64(), "first": pa.int32(), "words": pa.list_(pa.binary()), "grams": pa.list_(pa.list_(pa.int32())), "counts": pa.list_(pa.int64()),
    "doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "held": pa.list_(pa.int32()), "times": pa.list_(pa.int32()),
}
ROWS = "slice long, first int, words array<binary>, grams array<array<int>>, counts array<long>, doc_id long, n_words long, n_features long, held array<int>, times array<int>"


def word_codes(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, all words as places in that list, and how many each text has."""
    codes: dict[bytes, int] = {}
    found = [[codes.setdefault(w, len(codes)) for w in WORD.findall(t.lower())] for t in texts]  # bytes.lower() changes A-Z alone
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return list(codes), np.fromiter((c for f in found for c in f), np.int64, int(lengths.sum())), lengths


def gram_codes(codes: np.ndarray, lengths: np.ndarray, n_words: int, low: int, high: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Distinct runs of ``low`` to ``high`` words as lists of word codes, every run as a place in that list, and its text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # words from here to the text's end
    known, at = [[w] for w in range(n_words)], codes  # runs of one word are the words
    grams, places, texts = [], [], []
    for n in range(1, high + 1):
        if n > 1:
            # A run of n words is a run of n - 1 and its last word.
            whole = left[: len(at)] >= n
            pairs = np.where(whole, at * n_words + np.append(codes, np.zeros(n, np.int64))[n - 1 : n - 1 + len(at)], -1)
            distinct, at = np.unique(pairs, return_inverse=True)
            known = [known[p // n_words] + [p % n_words] if p >= 0 else [] for p in distinct.tolist()]
        if n >= low:
            inside = left >= n
            used, local = np.unique(at[inside], return_inverse=True)
            places.append(local + len(grams))
            grams += [known[u] for u in used.tolist()]
            texts.append(text[inside])
    return grams, np.concatenate(places), np.concatenate(texts)


def rows_of(**columns) -> pa.RecordBatch:
    """Rows of ``ROWS``; columns that are not given are null."""
    n = len(columns["slice"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in KINDS.items()], list(KINDS))


def parts(number: int, first: int, items: list, counts: np.ndarray | None, name: str) -> pa.RecordBatch:
    """``items`` (words or n-grams, whose places in the slice begin at ``first``) and their counts, PART to a row."""
    starts = range(0, len(items), PART)
    told = {} if counts is None else {"counts": [counts[k : k + PART] for k in starts]}
    return rows_of(slice=[number] * len(starts), first=[first + k for k in starts], **{name: [items[k : k + PART] for k in starts]}, **told)


def sliced(docs: DataFrame, low: int, high: int, doc: str | None, text: str, label: str) -> DataFrame:
    """Of each slice of texts rows with its words, rows with its n-grams, both with counts, and a row per document with
    the n-grams that it holds; without ``doc`` no documents."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            raw, at = utf8(batch.column(1))
            for a, b in slices(at, SLICE):
                words, codes, lengths = word_codes([raw[at[k] : at[k + 1]].tobytes() for k in range(a, b)])
                grams, places, texts = gram_codes(codes, lengths, len(words), low, high)
                counts = np.bincount(places, minlength=len(grams)).astype(np.int64)
                single = len(words) if low == 1 else 0  # runs of one word stand first, in the order of the words
                yield parts(number, 0, words, counts[:single] if low == 1 else None, "words")
                yield parts(number, single, grams[single:], counts[single:], "grams")
                if doc:
                    width = max(1, len(grams))
                    pairs, times = np.unique(texts * width + places, return_counts=True)
                    bounds = np.searchsorted(pairs, np.arange(b - a + 1) * width).astype(np.int32)
                    held = pa.ListArray.from_arrays(bounds, (pairs % width).astype(np.int32))
                    yield rows_of(
                        slice=np.full(b - a, number), doc_id=ids.slice(a, b - a), n_words=lengths, n_features=np.bincount(texts, minlength=b - a),
                        held=held, times=pa.ListArray.from_arrays(bounds, times.astype(np.int32)),
                    )
                number += 1

    rows = docs.select((F.col(doc) if doc else F.lit(None)).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(map_arrow(rows, run, ROWS), label)


def by_place(table: pa.Table, value: str) -> np.ndarray:
    """The values of a slice's places, which are told once each, from 0."""
    out = np.zeros(table.num_rows, np.int64)
    out[table.column("place").to_numpy()] = table.column(value).to_numpy()
    return out


def tuples_of(grams: pa.Table, named: pa.Table) -> pa.Table:
    """The n-grams of a slice as tuples of ids, from its rows of ``grams`` and the ids of its words."""
    ids, out = by_place(named, "id"), []
    kinds = pa.schema([("wanted", pa.bool_()), ("slice", pa.int64()), ("place", pa.int32()), ("gram", pa.list_(pa.int64())), ("n", pa.int64())])
    for batch in grams.to_batches():
        runs = batch.column("grams").flatten()
        many = batch.column("grams").value_lengths().to_numpy()
        place = np.repeat(batch.column("first").to_numpy() - np.cumsum(many) + many, many) + np.arange(len(runs))
        gram = pa.ListArray.from_arrays(np.append(0, np.cumsum(runs.value_lengths().to_numpy())).astype(np.int32), ids[runs.flatten().to_numpy()])
        keys = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), many) for c in ("wanted", "slice")]
        out.append(pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(place, pa.int32()), gram, batch.column("counts").flatten()], schema=kinds))
    return pa.Table.from_batches(out, kinds)


def weigh(docs: pa.Table, gains: pa.Table) -> pa.Table:
    """The documents of a slice with the sums of their features' gains."""
    gain, out = by_place(gains, "gain"), []
    names = ["doc_id", "n_words", "n_features", "weight"]
    for batch in docs.to_batches():
        ends = np.cumsum(batch.column("held").value_lengths().to_numpy())
        total = np.append(0, np.cumsum(gain[batch.column("held").flatten().to_numpy()] * batch.column("times").flatten().to_numpy()))
        weight = total[ends] - total[np.append(0, ends[:-1])]
        out.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], pa.array(weight, pa.int64())], names))
    return pa.Table.from_batches(out, pa.schema([(c, pa.int64()) for c in names]))


def importance(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, doc: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight (the sum of its features' gains).

    Null and empty texts have no feature and weight 0.  Rows repeated with one id are weighed one by one; null ids
    stay null.  Texts of any length are read whole.  An empty target leaves every bucket to its smoothing.  Other columns
    are not read.  An empty ``docs`` gives no row.
    """
    source, wanted = sliced(docs, low, high, doc, text, "op13-source"), sliced(target, low, high, None, target_text, "op13-target")
    both = source.select(F.lit(False).alias("wanted"), "*").unionByName(wanted.select(F.lit(True).alias("wanted"), "*"))
    told = both.where("words IS NOT NULL").select("wanted", "slice", "first", "counts", F.posexplode("words").alias("at", "word"))
    dictionary = materialise(told.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "op13-words")
    n = F.element_at("counts", F.col("at") + 1) if low == 1 else F.lit(0).cast("long")
    named = told.select("wanted", "slice", (F.col("first") + F.col("at")).alias("place"), "word", n.alias("n")).join(dictionary, "word")
    tuples = named.select("wanted", "slice", "place", F.array("id").alias("gram"), "n") if low == 1 else None
    if high > 1:
        longer = both.where("grams IS NOT NULL").select("wanted", "slice", "first", "grams", "counts").groupBy("wanted", "slice")
        ids = named.select("wanted", "slice", "place", "id").toDF("wanted", "slice", "place", "id").groupBy("wanted", "slice")  # columns of their own
        spread = longer.cogroup(ids).applyInArrow(tuples_of, "wanted boolean, slice long, place int, gram array<long>, n long")
        tuples = spread if tuples is None else tuples.unionByName(spread)
    tuples = materialise(tuples, "op13-tuples")

    counted = tuples.groupBy("gram").agg(F.sum(F.when(F.col("wanted"), 0).otherwise(F.col("n"))).alias("s"), F.sum(F.when(F.col("wanted"), F.col("n")).otherwise(0)).alias("t"))
    spelled = counted.select("gram", "s", "t", F.posexplode("gram").alias("pos", "id")).join(dictionary, "id")
    spelled = spelled.groupBy("gram", "s", "t").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).getField("word").alias("words"))
    bucket = F.pmod(F.crc32(F.concat_ws(" ", "words").cast("binary")), F.lit(buckets))
    hashed = materialise(spelled.select("gram", bucket.alias("bucket"), "s", "t"), "op13-buckets")

    sums = hashed.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = hashed.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    gains = sums.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("int").alias("gain"))
    gain = hashed.join(F.broadcast(gains), "bucket").select("gram", "gain")  # at most ``buckets`` rows are broadcast

    back = tuples.where(~F.col("wanted")).select("slice", "place", "gram").join(gain, "gram").select("slice", "place", "gain")
    kept = source.where("held IS NOT NULL").select("slice", "doc_id", "n_words", "n_features", "held", "times")
    return kept.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, **parameters) -> DataFrame:
    """``importance`` with score and rank: of the N rows with ``least_words`` words or more, the floor(percent * N / 100)
    highest scores are drawn.  The score adds Gumbel noise that depends on seed and id alone, so that drawing the
    highest is sampling without replacement in proportion to the weights.  Ties go to the smaller id.  Rows without an
    id have a weight, but no score and no part in N."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = importance(docs, target, **parameters).withColumns({"score": F.col("weight") + noise, "tie": F.monotonically_increasing_id()})
    scored = materialise(scored, "op13-scores")
    taking = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    drawn = percent * scored.where(taking).count() // 100
    ranked = numbered(scored.where(taking), [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("tie")], "op13-ranked")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    rest = scored.where(~taking).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(F.col("row") < drawn, F.col("row") + 1).alias("rank")).unionByName(rest)
