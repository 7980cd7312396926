"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, packing.

Every stage works on all rows that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, exact_dedup, language_id, packing, simhash
from gridloom.llm.common import materialise, table
from gridloom.llm.queries import tokenizer_path


def row_key() -> Column:
    """An id may stand on rows with different texts, so stages decide by id and text."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` beside each row as one struct, so that no column of ``docs``, whatever its name, meets a key."""
    return docs.select(*[key.alias(name) for name, key in keys.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language that holds half of the letters.  Rows without a
    doc_id go too, since no later stage could name them."""
    model = language_id.train(language_id.training_rows(docs), per_language=2000)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", *([F.struct(*others).alias("row")] if others else []))
    found = language_id.identify(whole, model, others=("row",) if others else (), keep_text=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*[F.col(f"row.`{c}`") if c in others else F.col(c) for c in docs.columns])


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (lower-cased A-Z; null is empty) the largest doc_id stays; a row repeated with its id stays once.
    Long texts are compared whole; an empty table stays empty; other columns go along whatever their names."""
    groups = exact_dedup.exact_groups(docs)
    key = ["doc_id", "text_sha256"]
    kept = materialise(groups.where("kept").select(*key).distinct(), "pipeline-kept")
    named = keyed(docs, doc_id=F.col("doc_id"), text_sha256=F.sha2(exact_dedup.lower_ascii(F.coalesce("text", F.lit(""))), 256))
    return named.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar by five-word shingles (0.8 or more) the smallest doc_id stays; of an id that stands
    on several texts of a group, one.  Texts without a word, null ones included, are alike.  Texts of any length are
    compared whole; rows repeated whole stay or go together; an empty table stays empty; other columns go along."""
    keys = docs.select("doc_id", row_key().alias("row_key"))
    groups = simhash.similar_groups(docs.select(row_key().alias("doc_id"), "text"), shingle=5, similarity=0.8).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    kept = keys.join(groups.toDF("row_key", "component_id"), "row_key").groupBy("component_id").agg(first)
    kept = materialise(kept.select("first.row_key"), "pipeline-first")
    return keyed(docs, row_key=row_key()).join(kept, "row_key", "left_semi").select("row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within a tenth of its length in edits.  Null and empty texts stay,
    texts of any length are searched whole, and rows repeated whole stay or go together.  Without items, or without
    rows, nothing goes; other columns go along."""
    found = decontaminate.contaminated(docs.select(row_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialise(found.select(F.col("doc_id").alias("row_key")).distinct(), "pipeline-leaks")
    return keyed(docs, row_key=row_key()).join(gone, "row_key", "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids.  A null or empty text is its end id alone; texts of any
    length are cut into as many pieces as they need, rows repeated are packed each, and only id and text are read."""
    return packing.pack(docs, tokenizer_path(), window=4096, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", dedup_exact),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
