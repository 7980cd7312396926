"""Suffix-array dedup: bytes under a string of ``LENGTH`` bytes that also starts in an earlier document go.

The suffixes of interest are windows of LENGTH bytes.  Sorting every window of the corpus would move fifty times its
size, so a filter comes first.  A window's anchor is its smallest hashed K-gram; equal windows have equal anchors at
equal places.  Windows that share an anchor form one stretch of text, the anchor's context.

1. The texts are written once, dealt into parts of bounded size, as a table bucketed by part: what comes back to a
   part meets its texts without another exchange of them.
2. Every part sends the hashes of its anchors, sorted, to their buckets.  An anchor seen in one document only has no
   repeated window and is discarded; this is all that hashes decide.
3. Of the other anchors, every part sends its suffixes: the bytes from the anchor on, as a sorted front-coded run, and
   the few bytes before.  In an anchor's bucket the runs of all parts are merged by a loser tree that keeps each run's
   common prefix with the last output, and so never compares a known prefix again.  The merged order and its common
   prefixes tell which windows are equal, byte for byte, and each part learns which of its windows an earlier document has.
4. The answers meet the texts again, which mark and cut their bytes.

Skew: contexts that are equal within a part are compared there, and only the earliest document's goes on.  An anchor of
very many documents sends its windows instead of its contexts, which spread over buckets by their own bytes and fold
in every part.  Buckets follow from the bytes of the texts, so a task stays as large as it is, however many texts come.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shared_path, ship, slices, utf8

LENGTH, K = 50, 24
SPAN = LENGTH - K + 1  # K-grams in a window
SLICE = 1 << 20
PLACE = 31  # bits for a place in a slice; the hash's other bits choose the anchor
KEY_BITS = 40  # of an anchor's hash, by which the first filter knows it
_U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def power(n: int) -> np.uint64:
    return _U(pow(int(ODD), n, 2**64))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the K bytes at every place: 16 by doubling, and 8 more."""
    h = BYTE[raw]
    for n in (1, 2, 4):
        h = h[:-n] * power(n) + h[n:]
    eight = h
    sixteen = h[:-8] * power(8) + h[8:]
    return mixed(sixteen[:-8] * power(8) + eight[16:])


def pieces(at: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Of texts laid end to end (``at``: n + 1 offsets), stretches of about SLICE bytes: first row, place in it, first
    and last byte, and offsets of the rows in the stretch.  A longer text is cut so that no window is lost or doubled."""
    for a, b in slices(at, SLICE):
        i, j = int(at[a]), int(at[b])
        if j - i <= 2 * SLICE:
            yield a, 0, i, j, at[a : b + 1] - i
            continue
        for s in range(i, j - LENGTH + 1, SLICE):
            e = min(j, s + SLICE + LENGTH - 1)
            yield a, s - i, s, e, np.array([0, e - s])


def contexts(raw: np.ndarray, at: np.ndarray):
    """Of some texts laid end to end (``at``: n + 1 offsets): row, first window, windows, key, and the anchor's place
    in the context, for every context; and the hashes of all K-grams."""
    size = len(raw)
    if size < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    grams = gram_hashes(raw)
    key = (grams >> _U(PLACE) << _U(PLACE)) | np.arange(size - K + 1, dtype=np.uint64)
    least = key
    n = 1
    while n * 2 <= SPAN:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    rest = SPAN - n
    least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & _U((1 << PLACE) - 1)).astype(np.int64)
    windows = size - LENGTH + 1
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:windows]
    ok = np.arange(windows) + LENGTH <= at[row + 1]
    start = np.flatnonzero(ok & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~ok[:-1])))
    # A context ends before the next one, or before the first window that crosses its document's end.
    stop = np.minimum(np.append(start[1:], windows), at[row[start] + 1] - LENGTH + 1)
    # The least hashes crowd at the low end, so they are mixed again before they spread keys over buckets.
    mix = mixed(grams[anchor[start]] * ODD) >> _U(64 - KEY_BITS)
    return row[start], start, stop - start, mix, anchor[start] - start, grams


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> _U(KEY_BITS - 32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _bucketed(bucket: np.ndarray, buckets: int):
    """Of a sorted array of bucket numbers, each bucket's range."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(int(k), int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.uint64)


def ascending(x: np.ndarray) -> bytes:
    """Front coding for numbers: the first, and the steps between the others."""
    step = np.diff(x, prepend=x[:1])
    return int(x[0]).to_bytes(8, "little") + narrow(step)


def ascended(b: bytes) -> np.ndarray:
    return np.cumsum(wide(b[8:]), dtype=np.uint64) + _U(int.from_bytes(b[:8], "little"))


PARTED = "part long, row int, doc_id long, text string"
SENT = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("grams", pa.binary()), ("docs", pa.binary())])
TOLD = pa.schema([("part", pa.int64()), ("told", pa.binary())])
RUNS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), *[(n, pa.binary()) for n in ("shapes", "bytes", "docs", "places", "told")]])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
WHERE = np.dtype([("row", "<u4"), ("start", "<u4"), ("bits", "<u4")])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _parted(part_bytes: int):
    """Deals rows, as they come, into parts of about ``part_bytes``, and numbers them in their part."""

    def run(batches):
        part, row, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            sizes = np.diff(utf8(batch.column(1))[1]).tolist()
            parts, rows = [], []
            for size in sizes:
                if held and held + size > part_bytes:
                    part, row, held = part + 1, 0, 0
                parts.append(part)
                rows.append(row)
                row, held = row + 1, held + size + 1
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(rows, pa.int32()), batch.column(0), batch.column(1)], ["part", "row", "doc_id", "text"])

    return run


def _anchors(buckets: int):
    """For each part and bucket: the keys of its anchors, ascending, and in how many of its texts each stands (255: so many or more)."""

    def run(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for i, j in zip(edges, np.append(edges[1:], len(part)), strict=True) if len(part) else ():
                raw, at = utf8(batch.column(1).slice(i, j - i))
                found = []
                for a, _, x, y, edge in pieces(at):
                    row, _, _, key, _, _ = contexts(raw[x:y], edge)
                    found.append((key, row + a))
                key, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                first = np.append(True, key[1:] != key[:-1])[: len(key)]
                each = first | np.append(True, row[1:] != row[:-1])[: len(key)]
                at_key = np.flatnonzero(first)
                n = np.minimum(np.add.reduceat(each, at_key, dtype=np.int64), 255).astype(np.uint8) if len(key) else np.zeros(0, np.uint8)
                key = key[at_key]
                yield _batch([(k, int(part[i]), ascending(key[x:y]), n[x:y].tobytes()) for k, x, y in _bucketed(bucket_of(key, buckets), buckets)], SENT)

    return run


def _grouped(batches) -> Iterator[list[tuple]]:
    """The rows of each bucket that a task has; every bucket's are given up as soon as they are taken."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(bucket, []).append(tuple(row))
    for bucket in list(held):
        yield held.pop(bucket)


def _shared(hot: int):
    """For each part, its keys that stand in more than one text, with the lowest bit set from ``hot`` texts on."""

    def run(batches):
        for rows in _grouped(batches):
            keys = [ascended(g) for _, g, _ in rows]
            key, n = np.concatenate(keys), np.concatenate([np.frombuffer(d, np.uint8) for _, _, d in rows]).astype(np.int64)
            run_of = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            first = np.append(True, key[order][1:] != key[order][:-1])
            group = np.cumsum(first) - 1
            total = np.empty(len(key), np.int64)
            total[order] = np.add.reduceat(n[order], np.flatnonzero(first))[group]
            pick = total > 1
            told, run_of = key[pick] << _U(1) | (total[pick] >= hot).astype(np.uint64), run_of[pick]
            edges = np.searchsorted(run_of, np.arange(len(rows) + 1))
            yield _batch([(rows[k][0], ascending(told[i:j])) for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i], TOLD)

    return run


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of neighbours in sorted rows of equal length, and the bytes after them, end to end."""
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    lcp = np.append(0, lcp).astype(np.uint8)
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]]


def decoded(lcp: bytes, tails: bytes) -> tuple[list[int], list[bytes]]:
    out, last, at = [], b"", 0
    lcp = list(lcp)
    for n in lcp:
        last = last[:n] + tails[at : (at := at + LENGTH - n)]
        out.append(last)
    return lcp, out


class LoserTree:
    """Merges sorted runs of equally long strings.  Each run's head carries its common prefix with the string that came
    out last; a longer one wins at once, and only equal ones are compared, from there on."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.n = runs, len(runs)
        self.at = [0] * self.n
        self.lcp = [0] * self.n
        self.tree = [-1] * self.n
        winner = [-1] * self.n + list(range(self.n))
        for k in range(self.n - 1, 0, -1):
            winner[k], self.tree[k] = self.play(winner[2 * k], winner[2 * k + 1])
        self.best = winner[1] if self.n > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix becomes that with the winner."""
        if self.at[a] >= len(self.runs[a][1]):
            return b, a
        if self.at[b] >= len(self.runs[b][1]):
            return a, b
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        x, y, n = self.runs[a][1][self.at[a]], self.runs[b][1][self.at[b]], la
        if x == y:
            n, won = LENGTH, a < b
        else:
            while x[n] == y[n]:
                n += 1
            won = x[n] < y[n]
        if won:
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def __iter__(self):
        """(run, place in it, common prefix with the string before)."""
        for _ in range(sum(len(r[1]) for r in self.runs)):
            w = self.best
            yield w, self.at[w], self.lcp[w]
            self.at[w] += 1
            lcps = self.runs[w][0]
            if self.at[w] < len(lcps):
                self.lcp[w] = lcps[self.at[w]]
            k = (w + self.n) // 2
            while k:
                w, self.tree[k] = self.play(w, self.tree[k])
                k //= 2
            self.best = w


def _beside(raw: np.ndarray, at: np.ndarray, length: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of the ``length`` bytes that start at each place and go on by ``step``; zeros after them."""
    each = np.arange(width)
    inside = each < length[:, None]
    return np.where(inside, raw[np.where(inside, at[:, None] + step * each, 0)], 0).astype(np.uint8)


def _taken(raw: np.ndarray, edge: np.ndarray, told: np.ndarray):
    """Of the contexts in a stretch of text whose keys are told: (row, start, places before the anchor, windows, number
    of the first window in its context, key for the bucket, bytes from the anchor on, bytes before it)."""
    row, start, count, key, place, grams = contexts(raw, edge)
    at = np.minimum(np.searchsorted(told >> _U(1), key), len(told) - 1)
    pick = told[at] >> _U(1) == key
    hot = pick & (told[at] & _U(1) == 1)
    shift = np.zeros(len(row), np.int64)
    out = []
    for some in (np.flatnonzero(pick & ~hot), np.flatnonzero(hot)):
        r, s, c, k, p, sh = (x[some] for x in (row, start, count, key, place, shift))
        if len(some) and hot[some[0]]:
            # Windows of their own: each is all its bytes from its start on, and goes where these bytes send it.
            r, k, p = np.repeat(r, c), np.repeat(k, c), np.zeros(int(c.sum()), np.int64)
            sh = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
            window = np.repeat(s, c) + sh
            k = mixed(grams[window] ^ grams[window + LENGTH - K] * ODD) >> _U(64 - KEY_BITS)
            right = raw[window[:, None] + np.arange(LENGTH)]
            s, c = np.repeat(s, c), np.ones(len(r), np.int64)
        else:
            right = _beside(raw, s + p, c + LENGTH - 1 - p, LENGTH, 1)
        out.append((r, s, p, c, sh, k, right, _beside(raw, s + p - 1, p, SPAN - 1, -1)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _runs(buckets: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """A part's front-coded suffix runs, one for each bucket, and what its own texts tell each other."""
        told = [ascended(x) for x in answers.column("told").to_pylist() if x is not None]
        if not told or not len(texts):
            return pa.Table.from_batches([_batch([], RUNS)])
        told = np.sort(np.concatenate(told))
        texts = texts.filter(texts.column("doc_id").is_valid())
        part, number, doc_of = texts.column("part")[0].as_py(), texts.column("row").to_numpy(), texts.column("doc_id").to_numpy()
        raw, at = utf8(texts.column("text"))
        found = []
        for a, base, x, y, edge in pieces(at):
            row, start, *more = _taken(raw[x:y], edge, told)
            # The place in the text: a stretch holds whole texts from their start on, or a part of one text.
            found.append((row + a, start - edge[row] + base, *more))
        row, start, place, count, shift, key, right, left = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = bucket_of(key, buckets)
        whole = np.ascontiguousarray(np.concatenate([right, left, np.stack([place, count], 1).astype(np.uint8)], 1)).view(f"V{LENGTH + SPAN + 1}").ravel()
        order = np.lexsort((np.ascontiguousarray(left).view(f"S{SPAN - 1}").ravel(), np.ascontiguousarray(right).view(f"S{LENGTH}").ravel(), bucket))
        row, start, place, count, shift, bucket, right, left, whole = (x[order] for x in (row, start, place, count, shift, bucket, right, left, whole))
        doc = doc_of[row]
        first = np.append(True, (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1]))[: len(doc)]
        least = np.minimum.reduceat(doc, np.flatnonzero(first))[np.cumsum(first) - 1] if len(doc) else doc
        where = np.zeros(len(doc), WHERE)
        where["row"], where["start"], where["bits"] = number[row], start, ((1 << count) - 1) << shift
        later = doc > least
        out = [(part % buckets, part, None, None, None, None, where[later].tobytes())] if later.any() else []
        place, count, shift, bucket, right, left, doc, where = (x[~later] for x in (place, count, shift, bucket, right, left, doc, where))
        base = int(doc.min(initial=0))
        for k, i, j in _bucketed(bucket, buckets):
            lcp, tails = front_coded(right[i:j])
            lefts = left[i:j][np.arange(SPAN - 1) < place[i:j, None]]
            shapes = np.concatenate([lcp, place[i:j].astype(np.uint8), count[i:j].astype(np.uint8), shift[i:j].astype(np.uint8)]).tobytes()
            docs = base.to_bytes(8, "little", signed=True) + narrow((doc[i:j] - base).astype(np.uint64))
            places = narrow(where["row"][i:j].astype(np.uint64)), narrow(where["start"][i:j].astype(np.uint64))
            packed = pa.compress(tails.tobytes() + lefts.tobytes(), "zstd", asbytes=True)
            out.append((k, part, shapes, packed, docs, len(places[0]).to_bytes(4, "little") + b"".join(places), None))
        return pa.Table.from_batches([_batch(out, RUNS)])

    return run


def _merge(batches):
    """What the parts told themselves, and for each part: contexts with the windows that an earlier document has, as bits.

    A window that starts p bytes before the anchor is shared by contexts that agree on the p bytes before it and on the
    LENGTH - p bytes from it on.  The merged order with its common prefixes tells the second for every p at once, and
    the order of the bytes before with theirs the first.
    """
    for rows in _grouped(batches):
        yield _batch([(part, told) for part, _, _, _, _, told in rows if told is not None], TOLD)
        rows = [r for r in rows if r[5] is None]
        if not rows:
            continue
        runs, lefts, shapes, docs, where = [], [], [], [], []
        for _, shape, packed, doc, places, _ in rows:
            lcp, place, count, shift = np.frombuffer(shape, np.uint8).reshape(4, -1).astype(np.int64)
            tail = int((LENGTH - lcp).sum())
            text = pa.decompress(packed, tail + int(place.sum()), "zstd", asbytes=True)
            runs.append(decoded(shape[: len(lcp)], text[:tail]))
            lefts.append(np.frombuffer(text, np.uint8, offset=tail))
            shapes.append((place, count, shift))
            docs.append(wide(doc[8:]).astype(np.int64) + int.from_bytes(doc[:8], "little", signed=True))
            cut = 4 + int.from_bytes(places[:4], "little")
            spot = np.zeros(len(lcp), WHERE)
            spot["row"], spot["start"] = wide(places[4:cut]), wide(places[cut:])
            where.append(spot)
        sizes = [len(r[0]) for r in runs]
        offsets = np.cumsum([0, *sizes]).tolist()
        order, lcps = np.empty(offsets[-1], np.int64), np.empty(offsets[-1], np.int64)
        for n, (r, at, lcp) in enumerate(LoserTree(runs)):
            order[n], lcps[n] = offsets[r] + at, lcp
        del runs
        place, count, shift = (np.concatenate(x) for x in zip(*shapes, strict=True))
        left = np.zeros((len(place), SPAN - 1), np.uint8)
        left[np.arange(SPAN - 1) < place[:, None]] = np.concatenate(lefts)
        run_of = np.repeat(np.arange(len(rows)), sizes)
        place, count, shift, left, doc, spot, run_of = (x[order] for x in (place, count, shift, left, np.concatenate(docs), np.concatenate(where), run_of))
        # Only suffixes that agree with a neighbour on the anchor at least can share a window.
        close = lcps >= K
        alike = np.flatnonzero(close | np.append(close[1:], False))
        breaks = np.cumsum(~close)[alike]
        lcps = np.where(np.append(True, breaks[1:] != breaks[:-1])[: len(alike)], 0, lcps[alike])
        place, count, shift, left, doc, spot, run_of = (x[alike] for x in (place, count, shift, left, doc, spot, run_of))
        before = np.argsort(np.ascontiguousarray(left).view(f"S{SPAN - 1}").ravel(), kind="stable")
        differ = left[before][1:] != left[before][:-1]
        agree = np.append(0, np.where(differ.any(1), differ.argmax(1), SPAN - 1))[: len(before)]
        bits = np.zeros(len(doc), np.int64)
        rank = np.empty(len(doc), np.int64)
        for p in range(SPAN):
            some = np.flatnonzero((place >= p) & (place - p < count))
            if not len(some):
                continue
            rank[before] = np.cumsum(agree < p)
            key = np.cumsum(lcps < LENGTH - p)[some] * (len(doc) + 1) + rank[some]
            by = np.argsort(key, kind="stable")
            first = np.append(True, key[by][1:] != key[by][:-1])
            least = np.empty(len(key), np.int64)
            least[by] = np.minimum.reduceat(doc[some][by], np.flatnonzero(first))[np.cumsum(first) - 1]
            seen = some[doc[some] > least]
            bits[seen] |= 1 << (place[seen] - p)
        hit = np.flatnonzero(bits)
        spot["bits"] = bits << shift
        hit = hit[np.argsort(run_of[hit], kind="stable")]
        edges = np.searchsorted(run_of[hit], np.arange(len(rows) + 1))
        yield _batch([(rows[k][0], spot[hit[i:j]].tobytes()) for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i], TOLD)


def _cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """A part's texts without the windows that its answers name."""
    raw, at = utf8(texts.column("text"))
    told = np.frombuffer(b"".join(x for x in answers.column("told").to_pylist() if x is not None), WHERE)
    number = texts.column("row").to_numpy()
    by = np.argsort(number)
    begin = at[:-1][by][np.searchsorted(number[by], told["row"])] + told["start"] if len(told) else np.zeros(0, np.int64)
    window = np.zeros(len(raw), np.int8)
    for j in range(SPAN):
        window[begin[(told["bits"] >> np.uint32(j) & 1).astype(bool)] + j] = 1
    window[LENGTH:] -= window[:-LENGTH].copy()
    gone = np.cumsum(window, dtype=np.int8) > 0
    out = []
    for r, doc in enumerate(texts.column("doc_id").to_pylist()):
        i, j = int(at[r]), int(at[r + 1])
        g = gone[i:j]
        n = int(g.sum())
        spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
        kept = (raw[i:j][~g] if n else raw[i:j]).tobytes()
        out.append((doc, j - i, n, spans, hashlib.sha256(kept).hexdigest(), kept))
    return pa.Table.from_batches([_batch(out, CUT)])


def remove_repeats(
    docs: DataFrame, part_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, hot: int = 20_000, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a string of 50 bytes that covers it also starts in a row with a smaller id; strings are judged on
    the input.  Null texts are empty; texts under 50 bytes lose nothing.  Rows repeated with one id do not see each
    other.  Rows with a null id lose nothing and remove nothing.  A text of any length is worked in stretches, and
    stands in a part of its own if it is longer than one.  Other columns are not read; an empty table gives an empty
    result.

    A part holds about ``part_bytes`` of texts, and there is a bucket for every ``bucket_bytes`` of them (100,000 at
    most, Spark's bound).  An anchor that ``hot`` texts or more hold spreads by its windows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(1, math.ceil(size / bucket_bytes)))
    path = shared_path(spark, "op6-texts")
    name = f"op6_texts_{uuid.uuid4().hex}"
    parted = map_arrow(rows, _parted(part_bytes), PARTED)
    parted.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "part").saveAsTable(name)
    texts = spark.table(name)
    sent = map_arrow(texts.where("doc_id IS NOT NULL").select("part", "text"), _anchors(buckets), ddl(SENT))
    told = materialise(map_arrow(sent.repartition(buckets, "bucket"), _shared(hot), ddl(TOLD)), "op6-told")
    ship(spark)
    runs = texts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_runs(buckets), ddl(RUNS))
    merged = materialise(map_arrow(runs.repartition(buckets, "bucket"), _merge, ddl(TOLD)), "op6-merged")
    return texts.groupBy("part").cogroup(merged.groupBy("part")).applyInArrow(_cut, ddl(CUT))
