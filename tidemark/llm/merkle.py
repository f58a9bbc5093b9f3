"""A Merkle manifest of a table: a tree over the rows of each group, and one over the groups.

Rows of a group are leaves in the order of an id; every ``ARITY`` consecutive nodes (at a
level's end also fewer, even one) are hashed into their parent until one node is left, the
group's subroot. The subroots, in the order of the groups, are the leaves of the upper tree.

A tree is stored in van Emde Boas order. One of a height above ``MOST`` is cut at half its
height into a top and the subtrees below it, and so are these, until all pieces are at most
``MOST`` high; a piece is a row of a block table. Within a block the same cut goes on down to
single nodes: first the top half, then the subtrees below it one behind the other, so a walk
from a leaf to the root stays within few cache lines or pages of any size. Where a node
lies follows from its depth and number alone (``address``): a block's nodes are one binary
value without pointers or keys. Trees are built from the lowest blocks up, each block's root
being a leaf of the block above, and proofs are read from the highest blocks down.

Positions come from a range partitioning and the counts of its partitions, so a group of any
size is numbered, built and read by many tasks; a block holds ``ARITY ** MOST`` leaves at most.

Defined cases: a null field is ``-`` and differs from an empty one; a null id comes first, and
rows with an equal id are in the order of their leaves, so equal rows are leaves beside each
other; a null group is a group, the first; an empty table has no root and no rows; other
columns are not hashed unless they are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .memory import give_back
from .storage import discard, store

ARITY = 3
#: Greatest height of a block: 729 leaves.
MOST = 6
_TEXTS = T.ArrayType(T.StringType())
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [ARITY**k for k in range(40)]


def digest(values: dict[str, Column]) -> Column:
    """SHA-256 of the values, each with its length in front, so that no two rows run together."""
    text = [c.cast("string") for c in values.values()]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def block_heights(height: int) -> list[int]:
    """Heights of the blocks between the leaves and the root of a tree, lowest first."""
    if height <= MOST:
        return [height]
    low = (height + 1) // 2
    return block_heights(low) + block_heights(height - low)


def size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, number: np.ndarray) -> np.ndarray:
    """Places, in the layout of a tree of ``levels``, of the nodes ``number`` at ``depth``."""
    at = np.zeros_like(number)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        width = ARITY ** (depth - top)
        at = at + size(top) + number // width * size(levels - top)
        number, depth, levels = number % width, depth - top, levels - top
    return at


def _parent(children: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in children).encode()).digest()


def _fill(nodes: bytearray, at: int, levels: int, below: list[bytes], leaves: bool) -> bytes:
    """Lay out the subtree at ``at`` and return its root.

    With ``leaves`` its lowest level is ``below`` itself, else the parents of ``below``.
    """
    if levels == 1:
        root = below[0] if leaves else _parent(below)
        nodes[32 * at : 32 * at + 32] = root
        return root
    top = levels // 2
    low = levels - top
    width = ARITY ** (low - 1 if leaves else low)
    first = at + size(top)
    roots = [_fill(nodes, first + k * size(low), low, below[a : a + width], leaves) for k, a in enumerate(range(0, len(below), width))]
    return _fill(nodes, at, top, roots, False)


def lay_out(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """The nodes of a block of ``height`` over ``leaves``, and its root; behind the last node nothing is stored."""
    nodes = bytearray(32 * size(height + 1))
    root = _fill(nodes, 0, height + 1, leaves, True)
    last = max(int(address(height + 1, d, np.array([_count(len(leaves), height, d) - 1]))[0]) for d in range(height + 1))
    return bytes(nodes[: 32 * (last + 1)]), root


def _count(leaves: int, height: int, depth: int) -> int:
    """Nodes at ``depth`` of a block of ``height`` over so many leaves."""
    return -(-leaves // ARITY ** (height - depth))


def siblings(nodes: bytes, height: int, leaves: int) -> list[list[tuple[str, str]]]:
    """For every leaf of a block, from its level up: the siblings before and those after it, as hex text."""
    by_depth = []
    for depth in range(height, 0, -1):
        n = _count(leaves, height, depth)
        row = [nodes[32 * a : 32 * a + 32].hex() for a in address(height + 1, depth, np.arange(n)).tolist()]
        by_depth.append([("".join(row[k - k % ARITY : k]), "".join(row[k + 1 : k - k % ARITY + ARITY])) for k in range(n)])
    return [[level[k // ARITY**d] for d, level in enumerate(by_depth)] for k in range(leaves)]


def folded(leaf: str, trail: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in trail:
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


@F.pandas_udf(T.StructType().add("nodes", T.BinaryType()).add("root", T.StringType()))
def _laid_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for leaves, heights in batches:
        made = [lay_out([bytes.fromhex(x) for x in row], h) for row, h in zip(leaves, heights, strict=True)]
        yield pd.DataFrame({"nodes": [n for n, _ in made], "root": [r.hex() for _, r in made]})
    give_back()


@F.pandas_udf(T.ArrayType(_TEXTS))
def _siblings(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Siblings of each leaf of a block; before and after with a comma between."""
    for nodes, heights, counts in batches:
        yield pd.Series([[[f"{a},{b}" for a, b in x] for x in siblings(*row)] for row in zip(nodes, heights, counts, strict=True)], dtype=object)
    give_back()


@F.pandas_udf(T.StructType().add("proof", _TEXTS).add("folded", _TEXTS))
def _proved(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Hash of all siblings of each leaf up to the root, and the root that ``claimed`` folds to."""
    for nodes, heights, claimed, trails in batches:
        proofs, roots = [], []
        for block, height, leaves, trail in zip(nodes, heights, claimed, trails, strict=True):
            above = [tuple(x.split(",")) for x in trail]
            paths = [own + above for own in siblings(block, height, len(leaves))]
            proofs.append([sha256("".join(a + b for a, b in path).encode()).hexdigest() for path in paths])
            roots.append([folded(leaf, path) for leaf, path in zip(leaves, paths, strict=True)])
        yield pd.DataFrame({"proof": proofs, "folded": roots})
    give_back()


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place in the group ``g`` in ``order``, and ``n``, the group's size."""
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = store(dealt, "merkle-order").withColumn("part", F.shiftright("at", 33))
    # A group has one row here for each partition that holds some of it.
    parts = dealt.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy("g").orderBy("part")) - F.col("rows")
    parts = parts.select("g", "part", "first", before.alias("before"), F.sum("rows").over(W.partitionBy("g")).alias("n"))
    return dealt.join(parts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before")


def _heights(n: Column) -> Column:
    total = F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))
    table = F.array(*[F.array(*[F.lit(h) for h in block_heights(k)]) for k in range(len(_POWERS))])
    return F.element_at(table, total + 1)


def _trees(entries: DataFrame, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """Block tables of the trees over ``entries`` (g, pos, n, leaf), lowest first; the lowest has arrays of the ``carried`` columns."""
    levels: list[DataFrame] = []
    now = entries.withColumn("heights", _heights(F.col("n")))
    depth = 1
    while len(levels) < depth:
        k = len(levels)
        height = F.get("heights", F.lit(k))
        width = F.get(F.array(*[F.lit(p) for p in _POWERS]), height)
        own = carried if k == 0 else ()
        rows = F.sort_array(F.collect_list(F.struct("pos", "leaf", *own)))
        grouped = now.withColumn("width", width).withColumn("block", F.expr("pos div width"))
        grouped = grouped.groupBy("g", "block").agg(F.first("heights").alias("heights"), rows.alias("rows"))
        table = grouped.select("g", "block", "heights", height.alias("height"), *[F.col(f"rows.{c}").alias(c) for c in ("leaf", *own)])
        table = table.withColumn("made", _laid_out("leaf", "height")).select("*", "made.nodes", "made.root").drop("made")
        table = store(table.withColumn("leaves", F.size("leaf")).drop("leaf"), "merkle-blocks")
        levels.append(table)
        if k == 0:
            depth = table.agg(F.max(F.size("heights"))).first()[0] or 1
        now = table.where(F.size("heights") > k + 1).select("g", F.col("block").alias("pos"), "heights", F.col("root").alias("leaf"))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """``(g, root)`` of each tree."""
    found = None
    for k, table in enumerate(levels):
        own = table.where(F.size("heights") == k + 1).select("g", "root")
        found = own if found is None else found.unionByName(own)
    return found


def _trails(levels: list[DataFrame], upper: DataFrame | None = None) -> DataFrame:
    """The lowest blocks with ``trail``, the siblings from the block's root up; ``upper`` (g, above) goes on behind a tree's root."""
    none = F.array().cast("array<string>")
    trail = None
    for k in range(len(levels) - 1, -1, -1):
        table = levels[k]
        if trail is not None:
            table = table.join(trail, ["g", "block"], "left")
        else:
            table = table.withColumn("trail", F.lit(None).cast("array<string>"))
        if upper is not None:
            # A tree's highest block has its trail from the upper tree; one below has it in its own.
            top = upper.select("g", "above")
            table = table.join(top, "g").withColumn("trail", F.coalesce("trail", "above")).drop("above")
        table = table.withColumn("trail", F.coalesce("trail", none))
        if k:
            each = table.select("g", "trail", F.posexplode(_siblings("nodes", "height", "leaves")).alias("at", "own"), "block", "height")
            width = F.get(F.array(*[F.lit(p) for p in _POWERS]), F.col("height"))
            trail = each.select("g", (F.col("block") * width + F.col("at")).alias("block"), F.concat("own", "trail").alias("trail"))
        else:
            return table
    raise ValueError("no levels")


@dataclass
class Manifest:
    """Block tables of the groups' trees and of the tree over them, lowest first, and the root (None: no rows)."""

    groups: list[DataFrame]
    upper: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def discard(self) -> None:
        for table in (*self.groups, *self.upper, self.subroots):
            discard(table)


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source") -> Manifest:
    """The manifest of ``leaves``: ``id_col``, ``group_col``, ``leaf`` (hex) and optionally ``claimed``, a leaf to be verified against it."""
    claimed = F.col("claimed") if "claimed" in leaves.columns else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    rows = leaves.select(group.alias("g"), F.col(id_col).alias("id"), "leaf", F.coalesce(claimed, "leaf").alias("claimed"))
    rows = store(rows, "merkle-leaves")
    numbered = _numbered(rows, ["id", "leaf"])
    groups = _trees(numbered, ("id", "claimed"))
    subroots = store(_roots(groups), "merkle-subroots")
    one = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("root").alias("leaf")), ["of"])
    upper = _trees(one, ("of",))
    top = _roots(upper).first()
    discard(rows)
    return Manifest(groups, upper, subroots, top and top["root"])


def proofs(made: Manifest, id_col: str = "doc_id") -> DataFrame:
    """A row for each leaf: ``id_col, leaf, subroot, root, proof_sha256`` of its siblings up to the root, ``folded_root`` of the claimed leaf and ``verified``."""
    highest = _trails(made.upper)
    above = highest.select("trail", F.explode(F.arrays_zip("of", _siblings("nodes", "height", "leaves").alias("own"))).alias("x"))
    above = above.select(F.col("x.of").alias("g"), F.concat("x.own", "trail").alias("above"))
    above = store(above.join(made.subroots.withColumnRenamed("root", "subroot"), "g"), "merkle-above")
    lowest = _trails(made.groups, above).join(above.select("g", "subroot"), "g")
    lowest = lowest.withColumn("p", _proved("nodes", "height", "claimed", "trail")).withColumn("leaf", _leaves("nodes", "height", "leaves"))
    each = lowest.select("subroot", F.explode(F.arrays_zip("id", "leaf", F.col("p.proof").alias("proof"), F.col("p.folded").alias("folded"))).alias("x"))
    root = F.lit(made.root)
    return each.select(
        F.col("x.id").alias(id_col), F.col("x.leaf").alias("leaf"), "subroot", root.alias("root"), F.col("x.proof").alias("proof_sha256"), F.col("x.folded").alias("folded_root"), (F.col("x.folded") == root).alias("verified"),
    )


@F.pandas_udf(_TEXTS)
def _leaves(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The leaves of a block, read from its nodes."""
    for nodes, heights, counts in batches:
        at = [address(h + 1, h, np.arange(n)).tolist() for h, n in zip(heights, counts, strict=True)]
        yield pd.Series([[block[32 * a : 32 * a + 32].hex() for a in places] for block, places in zip(nodes, at, strict=True)], dtype=object)
    give_back()
