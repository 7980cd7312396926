"""The operators' queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_text, language_id, merkle, packing, quality, resampling, sharding, simhash, suffix_dedup, toxicity, warc
from .common import crc_mod, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(n: int, rest: int):
    return F.coalesce(crc_mod("doc_id", n) == rest, F.lit(False)).alias("held_out")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"), records_per_file=2000)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 5) != 0), limit=1000)
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=4096, end_id=2)
    return packed.drop("ids")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.training_rows(docs), per_language=2000)
    return language_id.identify(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(crc_mod("doc_id", 3) != 1), limit=20_000)
    return quality.score(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), shown, arity=3)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024, low=1, high=1, buckets=10_000)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_sharding": op12_sharding,
    "op13_resampling": op13_resampling,
}

#: The 256 remainders of the CRC-32 polynomial, and the checksum of a text as SQL over them.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, b: xor(c // 256, crc.t[(xor(c % 256, b) + 1)::BIGINT]))"
    return f"CAST(xor({folded}, 4294967295::UBIGINT) AS BIGINT)"


def merkle_sql(levels: int = 12, top: int = 4) -> str:
    """The manifest level by level, for sources of up to 3 ** levels rows and up to 3 ** top sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def level(k: int) -> str:
        return f"""l{k + 1} AS (SELECT tree, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n,
            CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM l{k} GROUP BY tree, pos // 3)"""

    def beside(k: int) -> str:
        return f"""s{k} AS (SELECT a.tree, a.pos, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
            coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi FROM l{k} a JOIN l{k} b ON a.tree = b.tree AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.pos)"""

    steps, last = [], levels + top + 1
    steps += [level(k) for k in range(levels)]
    steps.append(f"l{levels + 1} AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM l{levels})")
    steps += [level(k) for k in range(levels + 1, last)]
    steps += [beside(k) for k in [*range(levels), *range(levels + 1, last)]]
    before = "d"
    for j, k in enumerate([*range(levels), *range(levels + 1, last)]):
        tree, pos = ("x.tree", f"x.pos // {3**k}") if k < levels else ("0", f"x.tree // {3 ** (k - levels - 1)}")
        steps.append(f"""f{j} AS (SELECT x.* REPLACE (x.proof || s.lo || s.hi AS proof, CASE WHEN s.n > 1 THEN sha256(s.lo || x.shown || s.hi) ELSE x.shown END AS shown)
            FROM {before} x JOIN s{k} s ON s.tree = {tree} AND s.pos = {pos})""")
        before = f"f{j}"
    body = "CASE WHEN {} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END".format(crc_sql("CAST(doc_id AS VARCHAR)"))
    head = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    return f"""WITH {CRC_TABLE},
        r AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf, sha256({head} || {field('(' + body + ')')}) AS shown FROM documents, crc),
        d AS (SELECT doc_id, leaf, shown, '' AS proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM r),
        l0 AS (SELECT tree, pos, n, leaf AS h FROM d),
        {', '.join(steps)}
        SELECT doc_id, leaf, l{levels}.h AS subroot, l{last}.h AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = l{last}.h AS verified
        FROM {before} x JOIN l{levels} ON l{levels}.tree = x.tree CROSS JOIN l{last}"""


ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        k AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS kept FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(hex, 10 * (i // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)],
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < kept THEN kept END AS refers_to
        FROM k""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
                   FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY norm)""",
    "op11_merkle": merkle_sql(),
    "op12_sharding": f"""
        WITH {CRC_TABLE},
        d AS (SELECT doc_id, coalesce(text, '') AS body, strlen(body) + 1 AS size, sha256(body) AS digest FROM documents),
        p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
              sum(size) OVER () AS total FROM d),
        g AS (SELECT pos, size, total, min(pos) OVER w AS lo, max(pos + size) OVER w AS hi FROM p WINDOW w AS (PARTITION BY digest)),
        cuts AS (SELECT CASE WHEN hi - lo > 0.02 * total / 8 THEN total * k // 8 WHEN total * k // 8 - lo <= hi - total * k // 8 THEN lo ELSE hi END AS edge
                 FROM g JOIN range(1, 8) r(k) ON pos <= total * k // 8 AND total * k // 8 < pos + size),
        s AS (SELECT *, CAST((SELECT count(*) FROM cuts WHERE edge <= pos) AS INTEGER) AS shard FROM p)
        SELECT doc_id, CAST(size AS BIGINT) AS size, {crc_sql('body')} AS text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s, crc""",
    "op13_resampling": rf"""
        WITH {CRC_TABLE},
        w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        o AS (SELECT doc_id, unnest(words) AS word FROM w),
        n AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM o UNION ALL SELECT word, 0, 1 FROM b) GROUP BY word),
        h AS (SELECT word, s, n.t, {crc_sql('word')} % 10000 AS bucket FROM n, crc),
        g AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(sum(s)) OVER () AS DOUBLE) AS all_s, CAST(sum(sum(t)) OVER () AS DOUBLE) AS all_t
              FROM h GROUP BY bucket),
        gain AS (SELECT word, CAST(floor(1000 * ln((g.t + 1) * (all_s + 10000) / ((g.s + 1) * (all_t + 10000)))) AS BIGINT) AS gain FROM h JOIN g USING (bucket)),
        x AS (SELECT doc_id, sum(gain) AS weight FROM o JOIN gain USING (word) GROUP BY doc_id),
        y AS (SELECT w.doc_id, len(words) AS n_features, coalesce(CAST(weight AS BIGINT), 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
              FROM w LEFT JOIN x USING (doc_id)),
        z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM y WHERE n_features >= 20)
        SELECT y.doc_id, n_features, weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= 10 * total // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)""",
}
