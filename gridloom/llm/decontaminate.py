"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from its copy in a document by at most ``budget`` edits.  Cut into budget + 1 pieces, at
least one piece then stands in the copy unchanged.  All pieces of a block of items form one Aho-Corasick automaton,
which a task builds once and runs over every whole text; each piece found fixes where the item would lie, and Myers'
bit-parallel distance over that stretch decides.  The documents are never shuffled.

The pigeonhole holds at every scale: halve a run of m pieces with at most m - 1 edits, and one half of k pieces has
at most k - 1.  So a piece found is followed up only while the runs of pieces around it, ever larger, match as well;
most chance hits end at the first run, after a few characters.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

SCHEMA = "doc_id long, item_id long, edits int, item_chars int, budget int, match_end long"


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length, with their places."""
    edges = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=1 << 14)
def runs_around(n: int, k: int) -> tuple[tuple[int, int], ...]:
    """Ranges of pieces that hold piece k when n pieces are halved again and again: the smallest first, without the
    piece itself and the whole."""
    found, lo, hi = [], 0, n
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if k < middle else (middle, hi)
        found.append((lo, hi))
    return tuple(x for x in reversed(found) if x[1] - x[0] > 1)


@lru_cache(maxsize=1 << 16)
def places(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in the pattern."""
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern of length m to any substring of ``text``, and the first place where
    such a substring ends.  ``masks`` has, for each character, the bits of its places in the pattern."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for k, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, k
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return best, end


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[int, str]], ratio: float):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for item_id, text in items:
            budget = int(len(text) * ratio)
            for n, (_, piece) in enumerate(pieces(text, budget)):
                found.setdefault(piece, []).append((len(self.items), n))
            self.items.append((item_id, text, budget))
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def promising(self, text: str, start: int, item: str, budget: int, n: int) -> bool:
        """Do the runs of pieces around piece n match, if the item's first character stood at ``start``?"""
        count = budget + 1
        for lo, hi in runs_around(count, n):
            a, b, edits = len(item) * lo // count, len(item) * hi // count, hi - lo - 1
            run = item[a:b]
            if best_match(places(run), b - a, text[max(0, start + a - edits) : start + b + edits])[0] > edits:
                return False
        return True

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, edits, length, budget, end) of each item that occurs, by its best place."""
        starts: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, n in where:
                _, item, budget = self.items[k]
                start = end - size + 1 - len(item) * n // (budget + 1)
                if start not in starts.get(k, ()) and self.promising(text, start, item, budget, n):
                    starts.setdefault(k, set()).add(start)
        found = []
        for k, at in starts.items():
            item_id, item, budget = self.items[k]
            m, masks = len(item), places(item)
            best, last = budget + 1, 0
            upto = None
            for a in sorted(at):
                lo, hi = max(0, a - budget), min(len(text), a + m + budget)
                if upto is not None and lo < upto[1]:
                    upto = (upto[0], max(upto[1], hi))
                    continue
                if upto is not None:
                    edits, end = best_match(masks, m, text[upto[0] : upto[1]])
                    if edits < best:
                        best, last = edits, upto[0] + end
                upto = (lo, hi)
            edits, end = best_match(masks, m, text[upto[0] : upto[1]])
            if edits < best:
                best, last = edits, upto[0] + end
            if best <= budget:
                found.append((item_id, best, m, budget, last))
        return found


def contaminated(
    docs: DataFrame, benchmark: DataFrame, ratio: float = 0.1, min_chars: int = 1, block_chars: int = 4_000_000,
    doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs (doc_id, item_id) whose document holds the item within ``ratio`` of its length in edits, with the
    smallest number of edits, the item's length and budget, and the end of the first best match (all in characters
    after lower-casing and joining white space).

    An item of under 10 characters must stand as it is.  Items of fewer than ``min_chars`` are left out; null texts are
    empty, so null and empty items are left out, and null documents match nothing.  Documents of any length are
    searched whole.  Repeated rows give repeated pairs; of items with equal texts each gives its pair.  Null ids stay
    null.  Items are taken in blocks of ``block_chars`` characters, each a pass over the documents that is written
    before the next, so what is held by the driver and sent to the tasks is bounded however long the benchmark is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    found, block, size = None, [], 0
    for x in items.toLocalIterator():
        if len(t := normal(x.t)) >= max(1, min_chars):
            if size and size + len(t) > block_chars:
                part = _pass(rows, block, ratio, written=True)
                found, block, size = part if found is None else found.unionByName(part), [], 0
            block.append((x.i, t))
            size += len(t)
    last = _pass(rows, block, ratio) if block or found is None else None
    return last if found is None else found.unionByName(last)


def _pass(rows: DataFrame, items: list[tuple[int, str]], ratio: float, written: bool = False) -> DataFrame:
    if not items:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def match(batches):
        matcher = Matcher(sent.value, ratio)
        for batch in batches:
            out = [
                (d, *hit)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for hit in matcher.find(normal(t))
            ]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    found = map_arrow(rows, match, SCHEMA)
    if written:
        found = materialise(found, "op9-pairs")
        sent.unpersist()
    return found
