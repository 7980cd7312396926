"""Language ID of mixed-language texts.

A word's score in a language is the log-likelihood of its letter trigrams, word ends included.  The scripts in which a
language was seen narrow the candidates of a word.  Viterbi with a penalty for each switch labels the words, and so
cuts a text into spans of one language; the language with the most letters is the text's.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, slices

TABLE_BITS = 16
#: First code point and name of the ranges that tell scripts apart; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"),
    (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"), (0x1C80, "cyrillic"),
    (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case (0 for what is no letter), its script."""
    n = 0x110000
    letter, lower = np.zeros(n, bool), np.zeros(n, np.uint32)
    for c in range(n):
        x = chr(c)
        if x.isalpha():
            letter[c], low = True, x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    first = np.array([a for a, _ in SCRIPTS])
    names = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], np.uint8)
    return letter, lower, names[np.searchsorted(first, np.arange(n), side="right") - 1]


def words(texts: list[str]):
    """Of texts: trigram buckets of all letters in order, first letter of each word, and each word's text, place,
    length and script.  A word is a run of letters."""
    letter, lower, script = tables()
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    low = lower[cp]
    is_letter = letter[cp]
    at = np.flatnonzero(is_letter)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    before = low[at - 1] if at[0] else np.concatenate((np.zeros(1, np.uint32), low[at[1:] - 1]))
    mix = before * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA77) ^ low[at + 1] * np.uint32(0xC2B2AE3D)
    mix ^= mix >> np.uint32(15)
    gram = (mix * np.uint32(0x27D4EB2F) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, np.diff(at) > 1))
    place = at[first]
    row = np.searchsorted(ends, place, side="right")
    return gram, first, row, place - (ends[row] - np.fromiter(map(len, texts), np.int64, len(texts))[row] - 1), np.diff(np.append(first, len(at))), script[cp[place]]


def viterbi(score: np.ndarray, start: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word.  Texts are worked side by side, the longest first, a word of each at a time."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    n = score.shape[1]
    back = np.zeros(score.shape, np.int16)
    own = np.arange(n)
    total = score[start[: active[0]]].copy() if len(active) else np.zeros((0, n))
    last = np.zeros(len(length), np.int64)
    for t in range(1, len(active)):
        k = active[t]
        if k < active[t - 1]:
            last[k : active[t - 1]] = total[k:].argmax(1)
            total = total[:k]
        best = total.argmax(1)
        jump = total[np.arange(k), best] - penalty
        stay = total >= jump[:, None]
        word = start[:k] + t
        back[word] = np.where(stay, own, best[:, None])
        total = np.where(stay, total, jump[:, None]) + score[word]
    if len(active):
        last[: active[-1]] = total.argmax(1)
    label = np.zeros(len(score), np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        word = start[:k] + t
        label[word] = last[:k]
        if t:
            last[:k] = back[word, last[:k]]
    return label


class Model:
    """Languages, log-likelihoods (bucket, language) and which scripts each language is seen in."""

    def __init__(self, langs: list[str], weights: np.ndarray, allowed: np.ndarray):
        self.langs, self.weights, self.allowed = langs, weights, allowed

    def word_scores(self, texts: list[str]):
        gram, first, row, place, size, script = words(texts)
        if not len(first):
            return np.zeros((0, len(self.langs)), np.float32), row, place, size
        score = np.add.reduceat(self.weights[gram], first, axis=0)
        ok = self.allowed[script]
        return np.where(ok | ~ok.any(1, keepdims=True), score, score - 1e4), row, place, size


def train(docs: DataFrame, per_language: int = 2000, share: float = 0.01, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Count letter trigrams on a sample of at most about ``per_language`` rows of each language (each kept with the
    probability that this needs, by a hash of its id and text).  A script counts as a language's if it has ``share`` of its letters."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc).alias("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    keep = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, per_language / sizes[name]))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(1 << 20)) < keep[F.col("lang")] * (1 << 20))

    def count(batches):
        held = np.zeros((len(langs), 1 << TABLE_BITS), np.int64)
        seen = np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            tags, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for k, name in enumerate(langs):
                gram, _, _, _, size, script = words([t for t, x in zip(texts, tags, strict=True) if x == name])
                held[k] += np.bincount(gram, minlength=1 << TABLE_BITS)
                seen[k] += np.bincount(script, weights=size, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        both = np.concatenate([held, seen], axis=1)
        k, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(both[k, b])], ["k", "b", "n"])

    counted = map_arrow(sample.select("lang", "text"), count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), (1 << TABLE_BITS) + len(SCRIPT_NAMES)))
    both[counted.k.to_numpy(np.int64), counted.b.to_numpy(np.int64)] = counted.n.to_numpy(np.float64)
    held, seen = both[:, : 1 << TABLE_BITS], both[:, 1 << TABLE_BITS :]
    smooth = 0.1
    weights = np.log((held + smooth) / (held.sum(1, keepdims=True) + smooth * (1 << TABLE_BITS)))
    return Model(langs, weights.T.astype(np.float32).copy(), (seen >= share * np.maximum(1, seen.sum(1, keepdims=True))).T.copy())


def identify(
    docs: DataFrame, model: Model, penalty: float = 8.0, doc: str = "doc_id", text: str = "text", others: tuple[str, ...] = (), keep_text: bool = False
) -> DataFrame:
    """doc_id, ``others`` (columns passed through), text (if kept), lang_pred, score and spans (start, length, lang; in
    characters).

    ``score`` is the share of the text's letters in spans of ``lang_pred``; ties go to the first name in order.  A
    null text, one without a letter, or any text where nothing was learned gives "und", score 0 and no span.
    Texts of any length are labelled whole.  Repeated rows and null ids are kept as they are; an empty table gives an
    empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("lang", pa.string())]))

    def found(texts: list[str]) -> list[pa.Array]:
        model, n = sent.value, len(sent.value.langs)
        score, row, place, size = model.word_scores(texts)
        if not n or not len(row):
            return [pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), span_type)]
        start = np.searchsorted(row, np.arange(len(texts)))
        length = np.diff(np.append(start, len(row)))
        label = viterbi(score, start[length > 0], length[length > 0], penalty)
        letters = np.bincount(row * n + label, weights=size, minlength=len(texts) * n).reshape(len(texts), n)
        best, whole = letters.argmax(1), letters.sum(1)
        shares = letters[np.arange(len(texts)), best] / np.maximum(whole, 1)
        langs = np.array([*model.langs, "und"], object)[np.where(whole > 0, best, n)]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])))
        final = np.append(new[1:], len(row)) - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(place[new], pa.int32()), pa.array((place + size)[final] - place[new], pa.int32()), pa.array(np.array(model.langs, object)[label[new]], pa.string())], ["start", "length", "lang"]
        )
        offsets = pa.array(np.searchsorted(row[new], np.arange(len(texts) + 1)), pa.int32())
        return [pa.array(langs, pa.string()), pa.array(shares), pa.ListArray.from_arrays(offsets, spans)]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
            kept = batch.num_columns - (not keep_text)
            names = [*batch.schema.names[:kept], "lang_pred", "score", "spans"]
            for a, b in slices(np.cumsum([0, *map(len, texts)]), 1 << 20):  # some million characters at a time
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *found(texts[a:b])], names)

    rows = docs.select(F.col(doc).alias("doc_id"), *others, F.col(text).alias("text"))
    fields = rows.schema.fields if keep_text else rows.schema.fields[:-1]
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(rows, run, passed + ", lang_pred string, score double, spans array<struct<start:int, length:int, lang:string>>")


def training_rows(docs: DataFrame, doc: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Rows from which may be learned: crc32 of the id as text is not 2 modulo 4."""
    return docs.where((crc_mod(doc, 4) != 2) & F.col(lang).isNotNull())
