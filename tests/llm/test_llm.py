"""The operators on small tables with nulls, empty and long texts, repeated rows, ties and clashing extra columns, each
against a brute-force version."""

from __future__ import annotations

import base64
import hashlib
import random
import string
import zlib

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from gridloom.llm import decontaminate, exact_dedup, html_text, language_id, packing, quality, queries, simhash, suffix_dedup, toxicity, warc
from gridloom.llm.suffix_dedup import LoserTree

rng = random.Random(11)
WORDS = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(40))


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents():
    base = sentence(60)
    texts = [None, "", " \t", "Hello World", "hello world", "HELLO WORLD", "one", base, base.upper(), base + " tail", base.replace(" ", "  ", 1)]
    texts += [sentence(10) + " " + PASSAGE + " " + sentence(12) for _ in range(4)] + [PASSAGE, PASSAGE, sentence(4000), "Ünïcode ßtraße 日本語 " * 6, "\x00 control \x01 text", "x" * 300]
    return [(10 * k + 3, t) for k, t in enumerate(texts)] + [(33, "Hello World"), (None, "no id"), (None, "")]


DOCS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", 1, "clash", 7) for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(t):
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in t or "")


# --- exact dedup


def test_exact_groups(docs, empty):
    want = {}
    for d, t in DOCS:
        want.setdefault(lower(t), []).append(d)
    got = exact_dedup.exact_groups(docs, capacity=2).collect()
    assert len(got) == len(DOCS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id is not None and r.doc_id == keep)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_chains_beyond_what_is_sent(docs):
    few, many = ([tuple(r) for r in exact_dedup.exact_groups(docs, capacity=2, bound=b).orderBy("doc_id", "text_sha256").collect()] for b in (0, 1000))
    assert few == many


def test_rows_find_each_other_through_the_directory(spark):
    """A directory that sends keys to other buckets than those they lie in finds nothing; the right one finds them all."""
    keys = spark.range(200).select(F.xxhash64("id").alias("key")).cache()
    slots, depths = exact_dedup.directory(keys, 8)
    held = exact_dedup.lookup(keys, slots, depths).cache()
    assert exact_dedup.probe(keys, held, slots, depths).count() == 200
    scrambled = slots.withColumn("bucket", F.col("bucket") + 1_000_000)
    assert exact_dedup.probe(keys, held, scrambled, depths).count() == 0
    assert exact_dedup.probe(keys, held, slots.where("bucket % 2 = 0"), depths).count() == held.where("bucket % 2 = 0").count() < 200


def test_texts_that_collide_on_a_key_are_told_apart(docs, monkeypatch):
    """Every text gets one of two keys, so chains hold many texts; groups are those of the real keys."""
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(map(tuple, exact_dedup.exact_groups(docs, capacity=2).select(columns).collect()), key=repr)
    hashed = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(hashed(*c), F.lit(2)))
    few = exact_dedup.exact_groups(docs, capacity=2)
    assert sorted(map(tuple, few.select(columns).collect()), key=repr) == want and few.select("bucket").distinct().count() == 1


def test_directory_splits_until_buckets_fit(spark):
    """Keys that agree on their low bits, and some that do not."""
    keys = sorted({k << 40 | 5 for k in range(-20, 20)} | {rng.getrandbits(63) for _ in range(100)} | {-1, 0, -(2**63), 2**63 - 1})
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    got = exact_dedup.lookup(table, *exact_dedup.directory(table, 3)).collect()
    assert sorted(r.key for r in got) == keys
    held = {}
    for r in got:
        mask = (1 << r.local_depth) - 1 if r.local_depth < 64 else -1
        assert r.key & mask == r.bucket if r.local_depth < 63 else (r.key - r.bucket) % (1 << r.local_depth) == 0
        held.setdefault((r.bucket, r.local_depth), []).append(r.key)
    assert max(map(len, held.values())) <= 3
    # A bucket's parent, of one bit less, was overfull.
    for (bucket, depth), _ in held.items():
        if depth:
            parent = sum((k - bucket) % (1 << (depth - 1)) == 0 for k in keys)
            assert parent > 3


# --- SimHash


def naive_print(text, shingle):
    words = lower(text).encode().translate(None).split()
    if not words:
        return 0
    grams = [b" ".join(words[a : a + shingle]) for a in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return find


def test_simhash_groups(docs, empty):
    prints = [naive_print(t, 3) for _, t in DOCS]
    find = groups_of(range(len(DOCS)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    members = {}
    for k, (d, _) in enumerate(DOCS):
        members.setdefault(find(k), []).append(d)
    want = sorted((d, prints[k], min((i for i in members[find(k)] if i is not None), default=None)) for k, (d, _) in enumerate(DOCS) if d is not None)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs).collect() if r.doc_id is not None)
    assert got == want
    assert simhash.near_groups(empty).count() == 0


def test_blocks_of_a_tile_meet(spark):
    """Random fingerprints in a few tiles, cut into tiny blocks."""
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(4)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, left_block=3, right_block=5).collect()
    find = groups_of(range(len(prints)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    at = {s: k for k, s in enumerate(signed)}
    assert all(bin((e.u ^ e.v) % 2**64).count("1") > 0 and find(at[e.u]) == find(at[e.v]) for e in edges)
    found = groups_of(range(len(prints)), lambda a, b, pairs={tuple(sorted((at[e.u], at[e.v]))) for e in edges}: (a, b) in pairs)
    assert [found(k) for k in range(len(prints))] == [find(k) for k in range(len(prints))]


def test_similar_groups(spark):
    base = sentence(200).split()
    near = base.copy()
    near[50], near[120] = "other", "words"
    rows = [(5, " ".join(base)), (6, " ".join(near)), (7, sentence(200)), (8, sentence(190)), (9, " ".join(base).upper())]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 7, 8: 8, 9: 5}


def test_similar_groups_are_those_of_exact_jaccard(spark):
    """Copies of a few texts with edits, so that similarities lie on both sides of 0.8; one common passage; tiny blocks."""
    own, rows = random.Random(5), []
    for size in (6, 30, 80, 200):
        for _ in range(4):
            base = [own.choice(WORDS) for _ in range(size)]
            rows.append(" ".join(base))
            for _ in range(8):
                copy = base.copy()
                for _ in range(own.randint(0, max(1, size // 20))):
                    copy[own.randrange(size)] = own.choice(WORDS)
                rows.append(" ".join([*copy, *PASSAGE.split()[: own.choice([0, 0, size // 5])]]))
    rows += [PASSAGE + " " + " ".join(own.choice(WORDS) for _ in range(k)) for k in range(8, 14)] + ["two words", "Two  words", "", None, " "]

    def sets(t):
        w = lower(t).split()
        return frozenset(" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()

    held = [sets(t) for t in rows]
    alike = {(a, b): len(held[a] & held[b]) / (len(held[a] | held[b]) or 1) if held[a] or held[b] else 1.0 for a in range(len(rows)) for b in range(a + 1, len(rows))}
    assert sum(0.7 <= j < 0.8 for j in alike.values()) > 20 and sum(0.8 <= j < 0.9 for j in alike.values()) > 20
    find = groups_of(range(len(rows)), lambda a, b: alike[a, b] >= 0.8)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for how in ({}, {"tile": 3, "block": 3}, {"tile": 5, "block_bytes": 900}):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(table, **how).collect()}
        assert got == {k: find(k) for k in range(len(rows))}
    assert simhash.similar_groups(table.where("false")).count() == 0


def test_tiles_of_wide_fingerprints_lose_no_pair(spark):
    """Random sizes and fingerprints around a few centres, in tiny blocks, against all pairs."""
    own, radius = np.random.default_rng(3), 63
    centres = [own.random(256) < share for share in (0.2, 0.35, 0.5) for _ in range(5)]
    bits = np.array([c ^ (own.random(256) < 0.16) for c in centres for _ in range(8)])
    n = own.integers(1, 40, len(bits))
    rows = [(k, int(n[k]), np.packbits(b, bitorder="little").tobytes(), int(b.sum())) for k, b in enumerate(bits)]
    apart = (bits[:, None] ^ bits[None]).sum(2)
    near = lambda a, b: apart[a, b] <= radius + 16 * (max(n[a], n[b]) <= 6) and min(n[a], n[b]) >= 0.8 * max(n[a], n[b])
    find = groups_of(range(len(rows)), near)
    edges = simhash.wide_links(spark.createDataFrame(rows, "node long, n long, fp binary, ones int"), radius, 0.8, block=7).collect()
    linked = {tuple(sorted((e.u, e.v))) for e in edges}
    found = groups_of(range(len(rows)), lambda a, b: (a, b) in linked)
    want = [find(k) for k in range(len(rows))]
    assert [found(k) for k in range(len(rows))] == want and 20 < len(set(want)) < len(rows)


def test_pipeline_near_dedup_loses_no_link_of_short_texts(spark, sf_dir):
    """Texts of eight words and the same with a ninth share four of five shingles: all such pairs are links."""
    import corpus_pipeline

    own = random.Random(8)
    texts = [" ".join(f"{own.getrandbits(40):x}" for _ in range(9)) for _ in range(1_500)]
    rows = [(k, t.rsplit(" ", 1)[0] if short else t) for i, t in enumerate(texts) for k, short in ((i, True), (i + 10_000, False))]
    kept = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(r.doc_id for r in kept) == list(range(1_500))


# --- repeats


def brute_repeats(rows):
    held = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in held:
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, b in held:
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\x01" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d or -1, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_repeats_are_removed(docs, empty):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(DOCS)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_overlapping_repeats(spark):
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + PASSAGE[rng.randint(0, 80) : rng.randint(120, 240)] + sentence(3)) for k in range(60)]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def removed(table, **how):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table, **how).collect())


def test_repeats_in_small_parts_and_hot_anchors(spark, docs):
    """Parts of a few texts, many buckets, and anchors that spread by their windows."""
    assert removed(docs, part_bytes=400, bucket_bytes=300) == brute_repeats(DOCS)
    assert removed(docs, part_bytes=400, bucket_bytes=300, hot=2) == brute_repeats(DOCS)
    own = random.Random(4)
    rows = [(k, "".join(own.choice("ab") for _ in range(own.randint(0, 30))) + PASSAGE[own.randint(0, 80) : own.randint(120, 240)] * own.randint(1, 2) + sentence(3)) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"hot": 5}, {"part_bytes": 1000, "bucket_bytes": 1000, "hot": 5}, {"part_bytes": 1}):
        assert removed(table, **how) == brute_repeats(rows)


def test_repeats_in_very_long_texts(spark):
    """A text is worked in stretches: repeats across their edges are found, and none is counted twice."""
    base = "".join(random.Random(2).choices(string.ascii_lowercase + " ", k=2_400_000))
    edge = suffix_dedup.SLICE
    rows = [(1, base), (2, "x" * 70 + base[edge - 100 : edge + 100] + "y"), (3, base[2 * edge - 3000 : 2 * edge + 3000]), (4, "q" * 40 + base[1000:1060])]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_loser_tree_sorts():
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(50)) for _ in range(n)) for n in (5, 0, 1, 9)]
    coded = [([next((k for k in range(50) if a[k] != b[k]), 50) if a else 0 for a, b in zip([b""] + r, r, strict=False)], r) for r in runs]
    assert [runs[r][k] for r, k, _ in LoserTree(coded)] == sorted(x for r in runs for x in r)


# --- packing


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, window=64).collect()
    seqs = {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert p.length == len(ids) and p.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for k, parts in seqs.items():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and (ends[-1] == 64 or k == max(seqs))
    for d, t in DOCS:
        if sum(x == d for x, _ in DOCS) == 1:
            own = sorted((p.start, p.ids) for p in pieces if p.doc_id == d)
            assert np.frombuffer(b"".join(i for _, i in own), "<u2").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    assert packing.pack(empty, path).count() == 0


def test_words_have_the_ids_of_the_tokenizer(monkeypatch):
    """Random texts of letters, marks, digits and odd spaces, also when the cache holds few words."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, own = Tokenizer.from_file(path), random.Random(3)
    signs = "aZ\xe9'\xdf\xc91\u0663\xbd\xb2\xaa.!\u2019\u0301\x00\x07\x1c   \n\t\u65e5\xff\xd7\u0130'sS''tRE_~"
    texts = ["".join(own.choice(signs) for _ in range(own.randint(0, 12))) for _ in range(3000)] + [sentence(500), "", "ab" * 40_000]
    for kept in (packing.WORDS_KEPT, 40):
        monkeypatch.setattr(packing, "WORDS_KEPT", kept)
        words = packing.WordIds(path, "<u2")
        assert words.letters_apart
        for k in range(0, len(texts), 50):
            ids, at = words.ids(pa.array(texts[k : k + 50]), b"\x02\x00")
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts[k : k + 50]]


# --- decontamination


def edit_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_contaminated_pairs(spark, docs, empty):
    items = [(1, PASSAGE[:120]), (2, "short"), (3, None), (4, sentence(20)), (5, PASSAGE[:120]), (6, PASSAGE[20:90].upper())]
    items += [(7, "e"), (8, "Hello Word"), (9, PASSAGE[30:45]), (10, ""), (None, "one")]
    bench = spark.createDataFrame([(*x, 9, "clash") for x in items], "item_id long, text string, doc_id int, edits string")
    more = []
    for k in range(20):
        copy = list(PASSAGE[:120])
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["q"], [copy[at], "z"]])
        more.append((1000 + k, sentence(8) + " " + "".join(copy) + " " + sentence(5)))
    rows = [(d, t) for d, t in DOCS if len(t or "") < 2000] + more
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            a, b = decontaminate.normal(x), decontaminate.normal(t)
            if a and (e := edit_in(a, b)) <= int(len(a) * 0.1):
                want[d, i] = e
    assert got == want and len(want) > 10 and {7, 8, 9, None} <= {i for _, i in want}
    blocks = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_chars=150).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in blocks} == want
    # A document far longer than the items, with one at its end.
    far = [(1, sentence(60_000) + " " + PASSAGE[:118] + "zz")]
    found = {r.item_id: r.edits for r in decontaminate.contaminated(spark.createDataFrame(far, "doc_id long, text string"), bench).collect()}
    assert found[1] == found[5] == edit_in(decontaminate.normal(PASSAGE[:120]), decontaminate.normal(far[0][1])[-400:]) and 6 in found
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


# --- WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://b.example.com/x?y=1", "<p>é</p>"), (2, "http://a.example.com/", None), (3, "http://www.a.example.com/", ""), (4, None, "<p>é</p>"), (5, "bad\r\nurl: x", "a\r\n\r\nWARC/1.1\r\nb")]
    rows += [(6, "http://a.example.com/", "z" * 100_000), (None, "http://c.example.com/", "<p>é</p>"), (None, "u", "alone"), (6, "http://a.example.com/", "z" * 100_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string").repartition(2)
    got = warc.archive(pages, records_per_file=2).collect()
    assert len(got) == len(rows)
    assert [(r.urlkey, r.timestamp) for r in got] == sorted((r.urlkey, r.timestamp) for r in got)
    found = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got))
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        kept = max((q for q, _, g in rows if (g or "") == (h or "") and q is not None), default=None)
        revisit = kept is not None and p != kept
        want.append((p or -1, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", kept if revisit else -1))
    assert found == sorted(want)
    assert warc.archive(pages.where("false")).count() == 0


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    """Small pages share archives; the larger ones stand in fewer and fewer; huge ids keep their order."""
    monkeypatch.setattr(warc, "SIZES", [(100, 4), (1000, 2), (None, 1)])
    lengths = [10] * 9 + [500] * 5 + [5000] * 3
    rows = [(k + (2**62 if k % 2 else -(2**40)), "http://a.example.com/", chr(97 + k) * n) for k, n in enumerate(lengths)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()
    assert [r.page_id for r in got] == sorted(p for p, _, _ in rows)
    held = {}
    for r in got:
        held.setdefault(r.archive, []).append(r.payload_bytes)
    assert sorted(sorted(x) for x in held.values()) == sorted([[10] * 4, [10] * 4, [10], [500] * 2, [500] * 2, [500], [5000], [5000], [5000]])


def test_runs_merge():
    runs = [sorted(rng.randrange(50) for _ in range(n)) for n in (4, 0, 7, 1)]
    assert list(warc.merged([[(x, x) for x in r] for r in runs])) == sorted(x for r in runs for x in r)
    assert list(warc.merged([])) == []


# --- HTML

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Home</ul></nav>
<div class=cookie-notice>We use cookies</div><article><header><h1>Head &amp; <b>line</b></h1></header><p>One<br>two &lt;3 a < b<p><b>Three <i>four<p>caf&eacute;&nbsp;x<script>var x="</p>";</script>
<ul><li>a<li>b</ul><div class="share-buttons">Share</div><form>Search</form></article><section id="comments"><article>I disagree</article></section><aside>More</aside><footer>&copy;</footer>"""


def kept_blocks(page):
    return [b for b, marked in html_text.extract(page)[0] if not marked]


def test_main_text():
    assert kept_blocks(PAGE) == ["Head & line", "One two <3 a < b", "Three four", "café x", "a", "b"]
    assert html_text.extract("")[0] == [] and kept_blocks("plain  text <é> &am") == ["plain text <é> &am"]


def test_slugs_of_the_article_are_not_marks():
    body = """<h1>Head</h1><h2 id="related-work">Related work</h2><p class="ad-hoc">One</p><section id="copyright-law"><p>Two</p></section><div id="banner-making"><p>Three</p></div>"""
    want = ["Head", "Related work", "One", "Two", "Three"]
    assert kept_blocks(f'<article>{body}<div class="related-posts">Else</div><p class="ad">Buy</p></article>') == want
    assert kept_blocks("<body><h2 id='search-results'>Search results</h2><p id='notice'>Four</p><div id='sidebar'>Else</div>") == ["Search results", "Four"]


def test_templates_go_and_copies_stay(spark):
    rows = [(k, f"http://h.example.com/{k}", f"<body><div><p>Welcome to our site</p></div><div><p>{sentence(12)}</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"http://h.example.com/c{k}", "<body><div><p>A copied article of the site</p></div></body>") for k in range(20)] + [(None, None, None), (7, "http://h.example.com/7", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, blocks string")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows) and all("Welcome" not in r.text for r in got) and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text == "A copied article of the site" for r in got) == 20 and sum(r.text == "" for r in got) == 2
    assert html_text.main_text(pages.where("false")).count() == 0


def test_long_templates_and_those_of_large_hosts_go(spark):
    notice = "<div><p>" + "All rights to what stands here are with the publisher of the site. " * 4 + "</p></div>"
    rows = [(k, "http://short.example.com/", f"<body><div><p>own {k} {sentence(3)}</p></div>{notice}</body>") for k in range(20)]
    rows += [(100 + k, "http://hot.example.com/", f"<body><div><p>own {k} {sentence(9)}</p></div>{notice if k % 10 == 0 else ''}</body>") for k in range(1200)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all("own" in r.text and "rights" not in r.text for r in got)


def test_count_removes_what_a_naive_count_does(spark):
    """Menus without a mark, from a pool, beside articles: those on three pages of the host or more go by count, and
    only those; what marks name goes anyway.  The naive version counts menus in the sources of the pages."""
    own = random.Random(8)
    menus = [f"<div><ul><li>Menu {k}</li><li>{sentence(2)}</li></ul></div>" for k in range(12)]
    rows, shown = [], {}
    for k in range(60):
        host, menu = f"h{own.randrange(4)}.example.com", menus[min(11, int(own.expovariate(0.3)))]
        article = "same words on two pages" if k in (7, 8) else f"own {k} " + sentence(6)
        rows.append((k, f"https://{host}/{k}", f"<body>{menu}<article><h1>T{k % 5}</h1><p>{article}</p></article><p>{sentence(3)}</p><footer>{k}</footer></body>"))
        shown.setdefault((host, menu), set()).add((f"T{k % 5}", article))
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, url, html in rows:
        menu = next(m for m in menus if m in html)
        often = len(shown[url.split("/")[2], menu]) >= 3
        assert (got[k].blocks_by_count, got[k].blocks_by_marks) == ((2, 2) if often else (0, 4))
        assert "own" in got[k].text or "same words" in got[k].text
    assert any(r.blocks_by_count for r in got.values()) and not all(r.blocks_by_count for r in got.values())


def test_what_some_articles_repeat_stays(spark):
    """A list inside a hundred and more of a host's articles is text; a notice inside all of them is a template."""
    shared, notice = "<ul><li>first point</li><li>second point</li></ul>", "<section><p>Read more on this site</p></section>"
    rows = [(k, "http://h.example.com/", f"<body><article><h1>T{k}</h1><p>own {k} {sentence(5)}</p>{shared if k % 4 == 0 else ''}{notice}</article></body>") for k in range(480)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(("first point" in r.text) == (r.page_id % 4 == 0) and "Read more" not in r.text and f"own {r.page_id} " in r.text for r in got)


def test_empty_comments():
    assert kept_blocks("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x --><p>d</p><!----><p>e</p>") == list("abcde")


def test_hot_templates_meet_in_parts(spark):
    rows = [(k, "http://h.example.com/", f"<body><div><p>Welcome to our site</p></div><div><p>own {k} {sentence(5)}</p></div></body>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", "url", "html")
    parsed = html_text.map_arrow(pages, html_text._parse, html_text.PARSED).cache()
    found = html_text.templates(parsed)
    cuts = [sorted((r.uid, sorted(map(tuple, r.cut))) for r in html_text.cuts(parsed, found, hot).collect()) for hot in (7, 20_000)]
    assert cuts[0] == cuts[1] and len(cuts[0]) == 40


def test_pages_of_template_only_and_deep_pages(spark):
    notice = "<div><p>All of this is the same everywhere</p></div>"
    rows = [(k, "http://h.example.com/", f"<body>{notice}<div><p>own {k} {sentence(4)}</p></div></body>") for k in range(12)]
    rows += [(50, "http://h.example.com/", f"<body>{notice}</body>"), (51, "http://deep.example.com/", "<div>x" * 20_000), (52, None, "<p>" + "word " * 200_000)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50].text == "" and got[50].n_chars == 0 and all("everywhere" not in got[k].text for k in range(12))
    assert got[51].text == "\n".join(["x"] * 20_000) and got[52].n_chars == 999_999


# --- models


def test_language(spark, docs, empty):
    one, two = ["ablo sento carita monda", "carita sento ablo"], ["schlag wurken braucht", "braucht nicht schlag"]
    train = spark.createDataFrame([(k, (one if k % 2 else two)[k // 2 % 2] * 3, "aa" if k % 2 else "bb") for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(train))
    rows = [(1, "carita monda sento ablo"), (2, "Schlag braucht nicht"), (3, None), (4, "12 !?"), (5, "carita sento ablo monda carita sento schlag wurken braucht nicht schlag wurken braucht"), (None, "")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, None)] == ["aa", "bb", "und", "und", "und"]
    assert {s.lang for s in got[5].spans} == {"aa", "bb"} and 0.5 <= got[5].score < 1
    assert language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_classifiers(spark, docs, empty):
    rows = [(k, sentence(20) + (" rotten scoundrel" if k % 3 == 0 else " gentle person")) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 0)) for k in range(90)] + [(500, None, None)], "doc_id long, toxic int, quality int")
    scored = {r.doc_id: r for r in toxicity.score(table, toxicity.train(table, labels)).collect()}
    assert all(scored[k].predicted == int(k % 3 == 0) and 0 <= scored[k].score <= 1 for k in range(90, 120))
    shouted = spark.createDataFrame([(k, sentence(15).upper() + "!!! ###" if k % 3 else sentence(15) + ".") for k in range(120)], "doc_id long, text string")
    good = {r.doc_id: r for r in quality.score(shouted, quality.train(shouted, labels)).collect()}
    assert all(good[k].predicted == int(k % 3 == 0) for k in range(90, 120))
    for module in (toxicity, quality):
        model = module.train(table, labels.where("false"))
        assert {r.score for r in module.score(docs, model).collect()} == {0.5} and module.score(empty, model).count() == 0


def naive_toxic(model, text):
    """The linear model by a loop over every n-gram of one text."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    held = set()
    for n in toxicity.SIZES:
        for a in range(len(low) - n + 1):
            x = low[a]
            for b in low[a + 1 : a + n]:
                x = (x * 0x100000001B3 + b) % 2**64
            held.add((x ^ x >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - toxicity.BITS)
    z = model.bias + sum(float(model.weights[h]) for h in held)
    return 1 / (1 + np.exp(-z))


def naive_trees(model, x):
    z = model.bias
    for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
        k = 0
        while k < len(feature):
            k = 2 * k + (2 if x[feature[k]] > threshold[k] else 1)
        z += value[k - len(feature)]
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_naive_loops(spark, docs):
    """Nulls, empty and long texts, repeated rows and clashing columns, with models of two classes."""
    import pyarrow as pa

    rows = [(k, sentence(20) + (" rotten scoundrel" if k % 3 == 0 else " gentle person"), sentence(15).upper() + "!!! ###" if k % 3 else sentence(15) + ".") for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, loud string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 0), "clash") for k in range(150)], "doc_id long, toxic int, quality int, text string").select("doc_id", "toxic", "quality")
    toxic = toxicity.train(table, labels)
    texts = [t for _, t in DOCS] + [t for _, t, _ in rows[:20]] + [None, "", sentence(3000) + " rotten scoundrel"]
    more = spark.createDataFrame([(k, t, 0.1, 7) for k, t in enumerate(texts)], "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r.score for r in toxicity.score(more.repartition(3), toxic).collect()}
    assert len(got) == len(texts) and all(abs(got[k] - naive_toxic(toxic, t)) < 1e-5 for k, t in enumerate(texts))
    assert len(set(got.values())) > 10
    good = quality.train(table.select("doc_id", "loud"), labels, text="loud")
    assert len(good.feature) > 0
    got = {r.doc_id: r.score for r in quality.score(more.repartition(3), good).collect()}
    x = quality.statistics(pa.array(texts, pa.string()))
    assert all(abs(got[k] - naive_trees(good, x[k])) < 1e-9 for k in range(len(texts))) and len(set(got.values())) > 1
    held = {r.doc_id: r for r in toxicity.score(docs, toxic).collect()}
    assert len(held) == len({d for d, _ in DOCS}) and toxicity.score(docs, toxic).count() == len(DOCS)


def test_statistics_are_those_of_naive_counts():
    import pyarrow as pa

    texts = ["One two two. - three!\n\n- three 4 x" + "y" * 30, None, "", "  \t", "Ünï, ünï"]
    at = {name: k for k, name in enumerate(quality.STATISTICS)}
    for row, t in zip(quality.statistics(pa.array(texts, pa.string())), [t or "" for t in texts], strict=True):
        raw, w = t.encode(), t.split()
        assert row[at["bytes"]] == len(raw) and row[at["words"]] == len(w)
        assert row[at["upper"]] == sum(65 <= b <= 90 for b in raw) / max(1, len(raw)) and row[at["high"]] == sum(b > 127 for b in raw) / max(1, len(raw))
        assert row[at["distinct_words"]] == len(set(w)) / max(1, len(w)) and row[at["long_words"]] == sum(len(x) > 20 for x in w) / max(1, len(w))
        assert row[at["repeated_pairs"]] == (1 - len(set(zip(w, w[1:], strict=False))) / (len(w) - 1) if len(w) > 1 else 0)


def test_spans_are_those_of_all_labellings():
    """Viterbi against every way to label the words of short texts, and spans of a long text."""
    from itertools import product

    own = np.random.default_rng(5)
    sizes = [0, 1, 3, 6, 2, 5]
    score = own.normal(size=(sum(sizes), 3)).astype(np.float32)
    start = np.cumsum([0, *sizes[:-1]])
    live = np.array(sizes) > 0
    label = language_id.viterbi(score, start[live], np.array(sizes)[live], 0.7)
    for s, n in zip(start, sizes, strict=True):
        value = lambda path, s=s: sum(score[s + k, c] for k, c in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        if n:
            assert abs(value(label[s : s + n]) - max(map(value, product(range(3), repeat=n)))) < 1e-5


def test_language_of_long_and_repeated_texts(spark):
    one, two = "ablo sento carita monda ", "schlag wurken braucht nicht "
    train = spark.createDataFrame([(k, (one, two)[k % 2] * 3, "ab"[k % 2] * 2) for k in range(40)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.training_rows(train))
    rows = [(1, one * 50_000 + two * 20_000), (2, two), (2, two), (2, one), (3, "Привет мир"), (4, "ablo " * 3 + "世界")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    found = sorted((r.doc_id, r.lang_pred) for r in got)
    assert len(got) == len(rows) and found[:4] == [(1, "aa"), (2, "aa"), (2, "bb"), (2, "bb")]
    long = next(r for r in got if r.doc_id == 1)
    assert [s.lang for s in long.spans] == ["aa", "bb"] and abs(long.score - 50_000 * 20 / (50_000 * 20 + 20_000 * 24)) < 1e-6


# --- pipeline


def test_pipeline_stages(spark, docs, empty, sf_dir):
    import corpus_pipeline

    for start in (docs, empty):
        found = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, found, sf_dir)
            assert found.columns == start.columns
        ids = [r.doc_id for r in found.collect()]
        assert None not in ids and len(set(ids)) == len(ids)
        assert corpus_pipeline.STAGES[-1][1](spark, found, sf_dir).where("doc_id IS NULL").count() == 0


def test_pipeline_tells_rows_of_one_id_apart(spark, sf_dir):
    """The clean text of an id stays where another text of that id is a near copy or a leak."""
    import corpus_pipeline

    base, clean = sentence(200), sentence(150)
    leak = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(r.text or "") >= 60)
    rows = [(1, base, "x"), (2, base + " tail", "x"), (2, clean, "y"), (3, leak, "x"), (3, clean[::-1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = corpus_pipeline.dedup_near(spark, docs, sf_dir)
    assert near.columns == docs.columns and sorted((r.doc_id, r.source) for r in near.collect()) == [(1, "x"), (2, "y"), (3, "x"), (3, "y")]
    found = corpus_pipeline.decontaminate_benchmark(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.source) for r in found) == [(1, "x"), (2, "x"), (2, "y"), (3, "y")]


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    """Columns named as the stages' own keys, nulls, repeated rows, and a very long text."""
    import corpus_pipeline

    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    rows = [(1, long, 111, "mine", "a"), (2, sentence(40), 222, "yours", None), (2, None, None, None, "b"), (3, sentence(30), 333, "c", "c")]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, row_key long, text_sha256 string, `row` string")
    kept = {r[0:3]: tuple(r) for r in docs.collect()}
    for stage in (corpus_pipeline.dedup_exact, corpus_pipeline.dedup_near, corpus_pipeline.decontaminate_benchmark):
        found = stage(spark, docs, sf_dir)
        got = found.collect()
        assert found.columns == docs.columns and {tuple(r) for r in got} == set(kept.values())


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(pieces) and (pieces.groupby("sequence_id").length.sum().sort_index()[:-1] == 4096).all()
