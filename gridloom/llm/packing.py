"""Packing by concatenation and cutting.

Pass one tokenizes every partition once, and writes each document's ids with its start inside the partition.  The
totals of the partitions, one number each, give every partition's global offset by a prefix sum.  Pass two adds the
two starts and cuts the endless stream into windows of a fixed length; a document that a window's end cuts leaves a
boundary record on either side.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, slices, utf8

#: White space other than the six ASCII kinds: texts that hold one are tokenized whole.
ODD_SPACE = re.compile("[\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: A letter before a mark, between which a tokenizer that keeps runs of letters apart may be given a blank.
LETTER_MARK = "([a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\\[-`{-~])"
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
#: Byte-level vocabularies write printable bytes as themselves, and the n-th of the others as character 256 + n.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - PRINTABLE))}
WORDS_KEPT = 300_000  # some 70 MB of a worker
SLICE = 1 << 21  # bytes of texts tokenized together, which hold some 60 MB of a worker; a longer text stands alone


class WordIds:
    """Ids of white-space separated words as little-endian bytes; each new word is tokenized once.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its words.  Where
    it also lower-cases and takes each run of letters for itself, marks are cut off before words are looked up, and a
    new run of letters goes straight to its vocabulary's merges.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {"": b""}
        probes = ("ab", "ouvielle", "\xe9t\xe9", "stra\xdfe", "\xf1and\xfa")
        whole = [self._whole(x) for x in probes]
        self.letters_apart = whole == [self._merged(x) for x in probes] == [self._whole(x.upper()) for x in ("ab", "ouvielle")] + whole[2:] and all(
            self._whole(f"{x}{mark}{x}") == self._whole(f"{x} {mark}{x}") for x in probes for mark in (",", ".'s", "-", "\\", "`", "_")
        )

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, letters: str) -> list[int]:
        return [x.id for x in self.model.tokenize(letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_CHARS))]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, new: list[str]) -> None:
        letters = [w for w in new if LETTERS.fullmatch(w)] if self.letters_apart else []
        found = [self._merged(w) for w in letters]
        size = np.dtype(self.kind).itemsize
        blob, last = np.array([x for ids in found for x in ids], self.kind).tobytes(), (np.cumsum([0, *map(len, found)]) * size).tolist()
        self.words.update(zip(letters, (blob[i:j] for i, j in zip(last, last[1:], strict=False)), strict=True))
        rest = [w for w in new if not LETTERS.fullmatch(w)] if self.letters_apart else new
        self.words.update(zip(rest, self._encoded(rest), strict=True))

    def ids(self, column: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, each text closed by ``end``, and the n + 1 offsets of its texts."""
        texts = column.to_numpy(zero_copy_only=False).tolist()
        whole = [k for k, t in enumerate(texts) if ODD_SPACE.search(t)]
        if whole:
            odd = self._encoded([texts[k] for k in whole])
            for k in whole:
                texts[k] = ""
            column = pa.array(texts, column.type)
        if self.letters_apart:
            column = pc.replace_substring_regex(pc.ascii_lower(column), LETTER_MARK, r"\1 \2")
        parts = pc.ascii_split_whitespace(column)
        coded = parts.flatten().dictionary_encode()
        seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = [self.words.get(w) for w in seen]
        if new := [w for w, x in zip(seen, known, strict=True) if x is None]:
            if len(self.words) + len(new) > WORDS_KEPT:
                self.words.clear()
                self.words[""], new = b"", [w for w in seen if w]
            self.learn(new)
            known = [self.words[w] for w in seen]
        # Beside the words' ids stand those of what closes a text: the end, after all ids where a text is taken whole.
        known += [end, *(x + end for x in odd)] if whole else [end]
        size = np.fromiter(map(len, known), np.int64, len(known)) // np.dtype(self.kind).itemsize
        flat, at = np.frombuffer(b"".join(known), self.kind), np.cumsum(size) - size
        close = np.full(len(texts), len(seen))
        close[whole] += 1 + np.arange(len(whole))
        last = np.asarray(parts.offsets)[1:] - parts.offsets[0].as_py()
        word = np.insert(coded.indices.to_numpy().astype(np.int64), last, close)
        count = size[word]
        done = np.cumsum(count)
        out = flat[np.repeat(at[word] - done + count, count) + np.arange(done[-1] if len(done) else 0)]
        return out, np.append(0, done[last + np.arange(len(last))])


@lru_cache(maxsize=1)
def word_ids(path: str, kind: str) -> WordIds:
    """Kept from task to task by a worker process."""
    return WordIds(path, kind)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u2", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table (part, doc_id, part_start, n_tokens, ids): ``ids`` as bytes of ``kind``, with ``end_id`` last."""

    def tokenize(batches):
        part, start, words, end = TaskContext.get().partitionId(), 0, word_ids(tokenizer, kind), np.array([end_id], kind).tobytes()
        width = np.dtype(kind).itemsize
        for batch in batches:
            doc_ids, column = batch.column(0).cast(pa.int64()), batch.column(1).fill_null("")
            for a, b in slices(utf8(column)[1], SLICE):
                ids, at = words.ids(column.slice(a, b - a), end)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * width), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part), pa.int32()), doc_ids.slice(a, b - a), pa.array(start + at[:-1]), pa.array(np.diff(at)), blobs],
                    ["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(at[-1])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(map_arrow(rows, tokenize, "part int, doc_id long, part_start long, n_tokens long, ids binary"), "op4-tokens")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, kind: str = "<u2", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut_before, cut_after, ids.

    Sequence s holds the tokens window * s to window * (s + 1) - 1 of the stream, so only the last is short.
    Null and empty texts give the end id alone.  Null ids stay null; rows repeated with one id are packed one by
    one.  Other columns are not read.  An empty table gives no piece.  ``kind`` is the width of an id.
    A text of any length is tokenized whole in the one task that reads it, and cut into as many pieces as it needs.
    """
    tokens = tokenized(docs, tokenizer, end_id, kind, doc, text)
    # One row per partition of the first pass; the prefix sum over them is a window over that small table.
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_offset"))

    width = np.dtype(kind).itemsize
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after", "ids"]

    def cut(batches):
        for batch in batches:
            at, blobs = batch.column("at").to_numpy(), batch.column("ids")
            n = pc.binary_length(blobs).to_numpy().astype(np.int64) // width
            data = np.frombuffer(blobs.buffers()[2], np.uint8)[int(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset]) :]
            ids, base = data[: int(n.sum()) * width].view(kind), np.cumsum(n) - n
            # Every document covers the windows from that of its first id to that of its last; each gives a piece.
            first = at // window
            count = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(sequence * window - at[row], 0)
            stop = np.minimum((sequence + 1) * window - at[row], n[row])
            wide = memoryview(ids.astype("<u4")).cast("B")
            lo, hi = (base[row] + start) * 4, (base[row] + stop) * 4
            crc = np.fromiter((zlib.crc32(wide[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(row))
            # The pieces lie end to end in the batch's ids.
            edges = np.append((base[row] + start) * width, len(ids) * width).astype(np.int32)
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids.tobytes())])
            columns = (start, stop - start, crc, n[row], sequence, (at[row] + start) % window, start > 0, stop < n[row])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *map(pa.array, columns), pieces], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut_before boolean, cut_after boolean, ids binary"
    # A row per partition of the input, hence far below any table's size.
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("at"), "ids")
    return map_arrow(placed, cut, schema)
