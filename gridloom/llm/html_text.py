"""Main text of web pages, with site templates removed.

A page becomes a tree of elements, tolerant of tags that are not closed, and its text becomes blocks in page order.

1. Every subtree that does not hold the article is hashed, and Spark counts on how many pages of its host, told apart
   by their texts, each hash stands.  Subtrees that recur go, with the blocks they cover: menus, adverts, footers and
   notices that a site puts on its pages.  Pages with one text (copies) count once, so copied articles are no templates.
2. What the count leaves open, on hosts of few pages or where a part stands on few of them, the page's own marks
   settle: tags, roles and classes of menus, headers, footers, sidebars, notices, adverts, forms and reader comments
   go, and where a page marks its article, the rest of it goes too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

#: Elements without an end tag, with raw text, and those that start a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th", "option", "br"))
#: An element of the first kind ends an open one of the second, unless one of the third lies between.
LISTS = frozenset(("ul", "ol", "menu", "dl"))
CLOSES = {
    "li": (frozenset(("li",)), LISTS), "dt": (frozenset(("dt", "dd")), LISTS), "dd": (frozenset(("dt", "dd")), LISTS),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))), "option": (frozenset(("option",)), frozenset(("select",))),
}
P_SCOPE = frozenset("article aside body button div footer form header html li main nav section table td th".split())
#: What is not the article: by tag, by role, and by the words of class and id.
DROPPED_TAGS = frozenset("nav aside footer form button select menu dialog template noscript svg canvas object audio video head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner sponsor sponsored promo"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related"
    " breadcrumb breadcrumbs pagination pager toolbar widget copyright alert form search".split()
)
#: Words that beside a dropped one still name a part of the page's layout.
PARTS = frozenset("area bar block box btn button buttons container content form icon icons inner item items links list panel posts section wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist replies reply respond discussion disqus".split())
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th caption figcaption".split())
CORE = frozenset(("article", "main"))
SOFT = frozenset("div section ul ol table figure details".split())

_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EMPTY_COMMENT = re.compile(r"<!---?>")
_MARKS = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements in page order (``tags``, ``parents``, ``marks``, ``hashes``, and the ``spans`` of pieces that they cover)
    and pieces of text (element, block, text)."""

    def __init__(self, source: str):
        from xxhash import xxh64_intdigest

        self.tags, self.parents, self.marks, self.hashes, self.spans = ["html"], [-1], [""], [0], [(0, 0)]
        self.pieces: list[tuple[int, int, str]] = []
        self._digest, self._parts, self._open, self._held, self._block = xxh64_intdigest, [["html"]], [0], Counter(), 0
        self._read(source)
        while self._open:
            self._pop()

    def _pop(self) -> None:
        k = self._open.pop()
        tag = self.tags[k]
        self._held[tag] -= 1
        self._block += tag in BLOCKS
        self.spans[k] = (self.spans[k][0], len(self.pieces))
        self.hashes[k] = h = self._digest("\x1f".join(self._parts.pop()).encode()) >> 1
        if self._parts:
            self._parts[-1].append(f"{h:x}")

    def _close(self, names: frozenset[str], bounds: frozenset[str]) -> None:
        """End the nearest open element of these names that lies within the bounds."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in names:
                while len(self._open) > k:
                    self._pop()
                return
            if tag in bounds:
                return

    def _text(self, text: str) -> None:
        words = html.unescape(text) if "&" in text else text
        if words:
            self.pieces.append((self._open[-1], self._block, words))
            if tidy := " ".join(words.split()):
                self._parts[-1].append("\x1e" + tidy)

    def _start(self, tag: str, marks: str, closed: bool) -> None:
        if tag in ("html", "body") and tag in self.tags:
            return
        if tag in BLOCKS and self._held["p"] > 0:
            self._close(frozenset(("p",)), P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self._block += tag in BLOCKS
        if tag in CELLS:
            self.pieces.append((self._open[-1], self._block, " "))
        if tag in VOID:
            return
        self._open.append(len(self.tags))
        self._held[tag] += 1
        self.tags.append(tag)
        self.parents.append(self._open[-2])
        self.marks.append(marks)
        self.hashes.append(0)
        self.spans.append((len(self.pieces), 0))
        self._parts.append([tag])
        if closed and tag not in BLOCKS:
            self._pop()

    def _end(self, tag: str) -> None:
        if self._held[tag] > 0:
            self._close(frozenset((tag,)), frozenset())

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            while lt >= 0 and not _OPENS.match(source, lt):
                lt = source.find("<", lt + 1)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            if source.startswith("<!--", lt):
                empty = _EMPTY_COMMENT.match(source, lt)
                end = source.find("-->", lt + 4)
                at = empty.end() if empty else n if end < 0 else end + 3
                continue
            ending = source[lt + 1] == "/"
            name = _NAME.match(source, lt + 1 + ending)
            if not name:  # a declaration, or no tag at all
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            attributes = _ATTRIBUTES.match(source, name.end())
            end = attributes.end() if attributes else source.find(">", name.end()) + 1
            if not end:  # the page breaks off inside a tag
                return
            tag, inside, at = name[0].lower(), source[name.end() : end - 1], end
            if ending:
                self._end(tag)
                continue
            self._start(tag, inside, inside.endswith("/"))
            if tag in RAW:
                stop = re.compile(f"</{tag}\\b", re.I).search(source, at)
                at = stop.start() if stop else n


def _names(words: set[str], some: frozenset[str]) -> bool:
    """Do the words of one class name a part of the page, and nothing else."""
    return bool(words & some) and words <= some | DROPPED_WORDS | PARTS


def _own(tag: str, marks: str, inside: bool) -> tuple[bool, bool]:
    """Does the element's tag or mark say that it is not the article; does it hold reader comments.  On headings and
    texts, and inside the article, ids are often made from the text: there only whole classes tell, and of the ids
    only that of comments."""
    if tag in ("html", "body"):
        return False, False
    dropped, comments = tag in DROPPED_TAGS or tag in RAW, False
    if marks and not marks.isspace():
        for name, value in _MARKS.findall(marks):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id") and (inside or tag in TEXTS):
                tokens = [{w.lower() for w in _WORDS.findall(token)} for token in value.split()]
                dropped |= name == "class" and any(_names(t, DROPPED_WORDS) for t in tokens)
                comments |= (name == "class" or tag not in TEXTS) and any(_names(t, COMMENT_WORDS) for t in tokens)
            elif name in ("class", "id"):
                words = {w.lower() for w in _WORDS.findall(value)}
                dropped |= bool(words & DROPPED_WORDS)
                comments |= bool(words & COMMENT_WORDS)
            elif name == "role":
                dropped |= value.strip().lower() in DROPPED_ROLES
            elif name == "style":
                dropped |= bool(_HIDDEN.search(value))
            else:
                dropped |= name == "hidden" or value == "true"
    return dropped, comments


def extract(source: str) -> tuple[list[tuple[str, bool]], list[tuple[int, int, int, bool, bool]], int]:
    """Of a page: its blocks, each with whether marks drop it (and without its text if so); the subtrees that may be a
    template, as (hash, first block, block after the last, does it lie beside a marked article, does it lie inside one);
    and a hash that tells pages' texts apart."""
    page = Page(source)
    n = len(page.tags)
    heads = [tag in ("h1", "main") for tag in page.tags]
    core = [tag in CORE for tag in page.tags]
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        heads[p] |= heads[k]
        core[p] |= core[k]
    gone, inside, article, raw = [False] * n, [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        p, tag = page.parents[k], page.tags[k]
        dropped, comments = _own(tag, page.marks[k], inside[p])
        inside[k] = inside[p]
        raw[k] = raw[p] or tag in RAW or tag == "head"
        if tag == "header" or (dropped and tag not in DROPPED_TAGS and tag not in RAW):
            # A mark on what holds the article tells of its layout; a header inside an article is the article's own.
            dropped = not (heads[k] or core[k] and tag not in CORE) and not (tag == "header" and inside[p])
        gone[k] = gone[p] or dropped or (comments and not heads[k])
        if tag in CORE and not gone[k]:
            inside[k] = True
            article[k] = tag == "article"
        else:
            article[k] = article[p]
    kept = [k for k, _, text in page.pieces if not gone[k] and not text.isspace()]
    marked = any(inside[k] for k in kept)
    scope = article if any(article[k] for k in kept) else inside if marked else [True] * n
    blocks: list[tuple[str, bool]] = []
    starts: list[int] = []  # the first piece of each block
    last, parts, any_text, first = -1, [], False, 0
    for at, (k, block, text) in enumerate([*page.pieces, (0, -2, "")]):
        if block != last:
            tidy = " ".join("".join(parts).split())
            if tidy or any_text:
                blocks.append((tidy, not tidy))
                starts.append(first)
            last, parts, any_text, first = block, [], False, at
        if not raw[k]:
            if not gone[k] and scope[k]:
                parts.append(text)
            any_text = any_text or not text.isspace() and text != ""
    elements: list[tuple[int, int, int, bool, bool]] = []
    spans: list[tuple[int, int]] = [(0, 0)] * n
    for k in range(1, n):
        tag, (a, b) = page.tags[k], page.spans[k]
        own = tag in SOFT if inside[k] else tag in BLOCKS and tag != "body"
        spans[k] = span = bisect_left(starts, a), bisect_left(starts, b)
        if own and not heads[k] and not core[k] and not raw[k] and span[0] < span[1] and span != spans[page.parents[k]]:
            elements.append((page.hashes[k], *span, marked and not inside[k], inside[k]))
        elif not own or heads[k] or core[k]:
            spans[k] = (0, 0)  # no candidate itself: what fills it may be one
    return blocks, elements, page._digest("\n".join(b for b, gone in blocks if not gone).encode()) >> 1


PARSED = (
    "uid long, page_id long, url string, host string, main long, blocks array<struct<text:string,marked:boolean>>,"
    " elements array<struct<subtree:long,first:int,stop:int,beside:boolean,inside:boolean>>"
)
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("marked", pa.bool_())]))
_ELEMENTS = pa.list_(pa.struct([("subtree", pa.int64()), ("first", pa.int32()), ("stop", pa.int32()), ("beside", pa.bool_()), ("inside", pa.bool_())]))


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    flat = [x for row in rows for x in row]
    columns = zip(*flat, strict=True) if flat else [[] for _ in kind.value_type]
    fields = list(kind.value_type)
    offsets = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields]))


def _parse(batches):
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            ids, urls, pages = (c.to_pylist() for c in part.columns)
            found = [extract(p or "") for p in pages]
            hosts = [m[1].lower() if (m := re.match(r"(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", u or "")) else "" for u in urls]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(uid, uid + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(hosts, pa.string()),
                    pa.array([m for _, _, m in found], pa.int64()), _lists([b for b, _, _ in found], _BLOCKS), _lists([e for _, e, _ in found], _ELEMENTS),
                ],
                ["uid", "page_id", "url", "host", "main", "blocks", "elements"],
            )
            uid += len(ids)


def templates(parsed: DataFrame, beside: int = 3, least: int = 8, share: float = 0.2, enough: int = 100, nearly: float = 0.9) -> DataFrame:
    """(host, subtree, n, anywhere, everywhere) that stands on n pages with different texts: on ``beside`` or more, which
    will do beside a marked article; ``anywhere`` if on ``least`` or more, and on ``share`` of the host's or on ``enough``,
    however large the host is, which will do on a page without a marked article; and ``everywhere`` if on ``least`` or
    more and on the share ``nearly`` of the host's, which alone will do inside a marked article.  Repeated sightings fold before every shuffle, so a host with a third of all pages is no heavier."""
    seen = parsed.select("host", "main", F.explode(F.array_distinct("elements.subtree")).alias("subtree")).distinct()
    counted = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min(beside, least))
    sizes = parsed.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    anywhere = (F.col("n") >= least) & (F.col("n") >= F.least(share * F.col("pages"), F.lit(enough)))
    everywhere = (F.col("n") >= least) & (F.col("n") >= nearly * F.col("pages"))
    told = counted.join(sizes, "host").select("host", "subtree", "n", anywhere.alias("anywhere"), everywhere.alias("everywhere"))
    return told.where((F.col("n") >= beside) | F.col("anywhere"))


def cuts(parsed: DataFrame, found: DataFrame, hot: int = 20_000) -> DataFrame:
    """(uid, cut): the ranges of each page's blocks that are templates.  A template on more than ``hot`` pages meets
    its sightings in as many parts as the commonest one needs; the templates of that kind are few, whatever the input."""
    sights = parsed.select("uid", "host", F.explode("elements").alias("e")).select("uid", "host", "e.*")
    most = found.agg(F.max("n")).first()[0] or 0
    joined = sights.join(found.where(F.col("n") <= hot), ["host", "subtree"])
    if most > hot:
        salts = -(-most // hot)
        salted = found.where(F.col("n") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = joined.unionByName(sights.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts))).join(salted, ["host", "subtree", "salt"]).drop("salt"))
    return joined.where("beside OR everywhere OR (anywhere AND NOT inside)").groupBy("uid").agg(F.collect_list(F.struct("first", "stop")).alias("cut"))


def _finish(batches):
    """Blocks that neither a template covers nor a mark drops, and how many went for each reason."""
    for batch in batches:
        texts, by_count, by_marks = [], [], []
        for blocks, cut in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            steps = np.zeros(len(blocks) + 1, np.int64)
            for c in cut or ():
                steps[c["first"]] += 1
                steps[c["stop"]] -= 1
            covered = np.cumsum(steps[:-1]) > 0
            texts.append("\n".join(b["text"] for b, gone in zip(blocks, covered.tolist(), strict=True) if not gone and not b["marked"]))
            by_count.append(int(covered.sum()))
            by_marks.append(sum(b["marked"] and not gone for b, gone in zip(blocks, covered.tolist(), strict=True)))
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(by_count, pa.int32()), pa.array(by_marks, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "blocks_by_count", "blocks_by_marks"])


def main_text(
    pages: DataFrame, beside: int = 3, least: int = 8, share: float = 0.2, page: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of every row, and how many blocks the count and the marks removed.

    White space inside a block is one space, and blocks are joined by one line end; character references are decoded.
    Null and empty pages, and pages whose text is all template, give an empty text.  A null URL belongs to the host "".
    Rows repeated with one id, null ids and copies of a page are each kept.  A page of any length or depth is parsed
    whole, in memory and time linear in it.  Other columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    parsed = materialise(map_arrow(rows, _parse, PARSED), "op3-parsed")
    found = materialise(templates(parsed, beside, least, share), "op3-templates")
    cut = materialise(cuts(parsed, found), "op3-cuts")
    left = parsed.join(cut, "uid", "left").select("page_id", "url", "blocks", "cut")
    return map_arrow(left, _finish, "page_id long, url string, text string, n_chars long, blocks_by_count int, blocks_by_marks int")
