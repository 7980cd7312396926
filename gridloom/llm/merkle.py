"""A Merkle manifest of a dataset, built bottom up by partial parents that become events once they are full.

Rows become leaves, ordered by id within their source.  A level of m nodes is cut into runs of ``arity``; each run is
hashed into its parent until one node, the source's subroot, remains, and the subroots are hashed likewise into the root.
How many children a parent has follows from the source's size alone, so no task waits for another: it keeps partial
parents, each with the digests of the children seen so far by position; the child that fills one makes the parent's
digest, which is an event for the grandparent.  What a task cannot fill is the frontier, which goes to the next round,
dealt by wider stretches of leaves.  Every round leaves a link from its nodes to the node that it reached and the siblings
passed on the way; followed backwards, from the root's round to that of the leaves, these links give the proofs.

Scale: texts are read once, for their leaves; what moves afterwards is some 100 bytes a row.  A block has at most
``arity ** LEVELS`` nodes, so it makes no difference that one source holds a third of the rows.  Rounds are as many as
the logarithm of the largest source to that base (3 for ten billion rows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_arrow, materialise, numbered

LEVELS = 7  # a round climbs so many levels: blocks of 2,187 leaves where three make a run
HELD = 100_000  # nodes of open blocks that a task keeps; beyond it the oldest block joins the frontier

NODE = ["tree", "size", "level", "at", "digest"]
LINK = "piece binary, top_level int, top_at long, top_digest binary, done boolean"


def parent_digest(run: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hexadecimal text."""
    return hashlib.sha256("".join(x.hex() for x in run).encode()).digest()


def height(size: int, arity: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


def siblings_of(at: int, width: int, arity: int) -> tuple[int, int]:
    """The place of node ``at`` in its run, and how many nodes the run has, on a level of ``width`` nodes."""
    return at % arity, min(arity, width - at // arity * arity)


class Block:
    """Nodes of one stretch of leaves of one tree."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.covered = 0

    def climbed(self, span: int, arity: int) -> Iterator[tuple]:
        """Each row with the siblings up to the highest node reached, that node, and whether it is the tree's root."""
        size = self.rows[0][1]
        top = height(size, arity)
        partial: dict[tuple[int, int], dict[int, bytes]] = {}
        runs: dict[tuple[int, int], tuple[list[bytes], bytes]] = {}
        events = [row[2:5] for row in self.rows]
        while events:
            level, at, digest = events.pop()
            if level == top or arity**level >= span:
                continue
            place, full = siblings_of(at, -(-size // arity**level), arity)
            parent = (level + 1, at // arity)
            children = partial.setdefault(parent, {})
            children[place] = digest
            if len(children) == full:
                run = [children[i] for i in range(full)]
                runs[parent] = run, parent_digest(run)
                del partial[parent]
                events.append((*parent, runs[parent][1]))
        reached: dict[tuple[int, int], tuple[bytes, int, int, bytes]] = {}
        for row in self.rows:
            level, at, digest = row[2:5]
            climb = []
            while (parent := (level + 1, at // arity)) in runs and (level, at) not in reached:
                climb.append((level, at, digest))
                level, at, digest = *parent, runs[parent][1]
            found = reached.setdefault((level, at), (b"", level, at, digest))
            for low, child, _ in reversed(climb):
                run, place = runs[low + 1, child // arity][0], child % arity
                found = reached[low, child] = (b"".join(run[:place] + run[place + 1 :]) + found[0], *found[1:])
            yield *row, *found, found[1] == top


def climbing(span: int, arity: int, fields: list[pa.Field], links: pa.Schema):
    """A map over Arrow batches of nodes: blocks of ``span`` leaves are climbed as soon as their nodes are there."""
    schema = pa.schema([*fields, *links])

    def rows_of(batches):
        blocks: dict[tuple[int, int], Block] = {}
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree, size, level, at = row[:4]
                first = at * arity**level
                key = tree, first // span
                block = blocks.get(key) or blocks.setdefault(key, Block())
                block.rows.append(row)
                block.covered += min(first + arity**level, size) - first
                held += 1
                if block.covered == min((key[1] + 1) * span, size) - key[1] * span or held > HELD:
                    done = blocks.pop(key if held <= HELD else next(iter(blocks)))
                    held -= len(done.rows)
                    yield from done.climbed(span, arity)
        for block in blocks.values():
            yield from block.climbed(span, arity)

    def run(batches):
        rows = []
        for row in rows_of(batches):
            rows.append(row)
            if len(rows) == 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def climb(nodes: DataFrame, span: int, arity: int) -> DataFrame:
    links = StructType.fromDDL(LINK)
    schema = StructType(nodes.schema.fields + links.fields)
    return map_arrow(nodes, climbing(span, arity, list(to_arrow_schema(nodes.schema)), to_arrow_schema(links)), schema)


def paths(nodes: DataFrame, arity: int, label: str) -> DataFrame:
    """``nodes`` (tree, size, level 0, at, digest and others) with ``path``, the siblings' digests from the node up to its
    tree's root, and ``root``.  The order of the rows only decides how much the first round can do by itself."""
    span = arity**LEVELS
    steps = [materialise(climb(nodes, span, arity), f"{label}-links")]
    while True:
        reached = steps[-1].where(~F.col("done")).select("tree", "size", F.col("top_level").alias("level"), F.col("top_at").alias("at"), F.col("top_digest").alias("digest"))
        frontier = materialise(reached.distinct(), f"{label}-frontier")
        if not frontier.limit(1).count():
            break
        span *= arity**LEVELS
        block = F.expr(f"(at * CAST(power({arity}, level) AS BIGINT)) DIV {span}")  # stretches by their first leaf
        dealt = frontier.repartition("tree", block).sortWithinPartitions("tree", "level", "at").select(*NODE)
        steps.append(materialise(climb(dealt, span, arity), f"{label}-links"))
    above = None
    for step in reversed(steps):
        if above is None:
            above = step.withColumns({"path": F.col("piece"), "root": F.col("top_digest")})
        else:
            upper = above.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("at").alias("a"), F.col("path").alias("rest"), F.col("root").alias("high"))
            met = (F.col("tree") == F.col("t")) & (F.col("top_level") == F.col("l")) & (F.col("top_at") == F.col("a"))
            joined = step.join(upper, met, "left")
            above = joined.withColumns({"path": F.concat("piece", F.coalesce("rest", F.lit(b""))), "root": F.coalesce("high", "top_digest")})
    return above.select(*nodes.columns, "path", "root")


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = col.cast("string")
    return F.when(col.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def folded(start: bytes, at: int, size: int, siblings: list[bytes], arity: int) -> bytes:
    """The root that follows from a leaf and its siblings; takes what it uses from the front of ``siblings``."""
    while size > 1:
        place, full = siblings_of(at, size, arity)
        run = [siblings.pop(0) for _ in range(full - 1)]
        start = parent_digest([*run[:place], start, *run[place:]])
        at, size = at // arity, -(-size // arity)
    return start


def audit(batches, arity: int):
    """Proofs as one digest each, and the roots that follow from the leaves at hand."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = row["path"] + row["top_path"]
            siblings = [whole[i : i + 32] for i in range(0, len(whole), 32)]
            proof = hashlib.sha256(whole.hex().encode()).hexdigest()
            end = folded(folded(row["shown"], row["at"], row["size"], siblings, arity), row["ordinal"], row["sources"], siblings, arity)
            root = row["root"]
            out.append((row["doc_id"], row["digest"].hex(), row["subroot"].hex(), root.hex(), proof, end.hex(), end == root))
        if out:
            types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def manifest(docs: DataFrame, shown: Column | None = None, arity: int = 3, doc: str = "doc_id", source: str = "source", text: str = "text", others: tuple[str, ...] = ("lang", "n_chars")) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``shown`` is the text that is to be verified against the manifest, an expression over ``docs``; without it the rows'
    own text.  Nulls in any column are hashed as ``-``, an empty text as ``0:``.  A null source is a source of its own,
    before all others; null ids come first in their source.  Rows repeated with one id are leaves of their own, ordered
    by their leaf's digest, so equal rows may exchange places.  Texts of any length are hashed whole.  Other columns are
    not read.  An empty table gives no row.
    """
    columns = [F.col(doc), F.col(source), *map(F.col, others), F.col(text)]
    rows = docs.select(
        F.col(doc).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), leaf(columns).alias("digest"),
        leaf([*columns[:-1], F.col(text) if shown is None else shown]).alias("shown"), F.monotonically_increasing_id().alias("tie"),
    )
    rows = materialise(rows, "op11-leaves")
    sizes = numbered(rows.groupBy("source").agg(F.count("*").alias("size")), [F.asc_nulls_first("source")], "op11-sources", sums=("size",))
    trees = materialise(sizes.select(F.col("source").alias("name"), "size", F.col("row").alias("ordinal"), F.col("size_before").alias("tree")), "op11-trees")
    joined = rows.join(trees, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    ordered = numbered(joined, [F.asc("tree"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("tie")], "op11-ordered")
    nodes = ordered.select("tree", "size", F.lit(0).alias("level"), (F.col("row") - F.col("tree")).alias("at"), "digest", "doc_id", "shown", "ordinal")
    below = materialise(paths(nodes, arity, "op11").withColumnRenamed("root", "subroot"), "op11-paths")

    subroots = materialise(below.select("ordinal", "subroot").distinct(), "op11-subroots")
    sources = subroots.agg(F.count("*").alias("n")).first()["n"]
    upper = subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(sources).cast("long").alias("size"), F.lit(0).alias("level"), F.col("ordinal").alias("at"), F.col("subroot").alias("digest"))
    top = paths(upper.sort("at"), arity, "op11-top").select(F.col("at").alias("o"), F.col("path").alias("top_path"), "root", F.col("size").alias("sources"))
    proved = below.join(top, F.col("ordinal") == F.col("o")).select("doc_id", "digest", "shown", "at", "size", "path", "subroot", "ordinal", "sources", "top_path", "root")
    return map_arrow(proved, lambda batches: audit(batches, arity), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
