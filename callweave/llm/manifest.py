"""Merkle manifest of a dataset: a leaf per row, a tree per language, a root over all, and a proof for every leaf.

A hash H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. A leaf hashes the columns of a
row, each as its length in UTF-8 bytes, a colon and the value, or `-` for null. The leaves of a tree stand in ascending order,
and level by level each two neighbours become their H, a lone last one its own, until one node is left.

How it runs on Spark:

1. leaves are hashed by the JVM, range-partitioned by tree and order and written once; a count per tree and range gives every
   leaf its position in its tree, so one tree may hold all rows;
2. a superblock is 2^10 neighbouring positions. Reducing one gives the node above it, and these nodes are leaves of a tree
   with 2^10 times fewer rows, handled in the same way until each tree is one superblock. The trees' tops are in turn the leaves
   of one last tree;
3. on the way back each superblock's nodes are cogrouped with the outer nodes that the superblock needs (one row: the siblings on
   the way from its top to the root). The task reduces the superblock once more, joins the proofs inside it with the outer
   ones, and for leaves folds the proof. No group is larger than a superblock, and an outer row has 2 hashes a level at most.

* Order in a tree: the order column, null first, then the leaf, so repeated rows are leaves of their own and the result does not
  depend on how Spark deals rows out. Trees are ordered by their value, null first, by UTF-8 bytes.
* A null in any column is a leaf's `-`; a row whose id is null is a leaf too, and is reported. An empty text has length 0; a very
  long one is hashed in one row by the JVM. Other columns do not count. An empty table has no leaves and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.tables import in_tables

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10  # a superblock has 2^10 nodes

LEFT, RIGHT, NONE = 0, 1, 2  # where the sibling stands

#: For each node: the levels above it, as sides and the siblings' hashes.
_PATH = "sides binary, siblings binary"
_NODES = "tree long, pos long, node binary"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(fields: dict[str, Column]) -> Column:
    """H of a row's values: text, or numbers in decimal."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered(doc_id: Column) -> Column:
    """Rows of which a copy with other values is checked against the original proof."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", tree: str = "lang", counter: str = "n_chars") -> DataFrame:
    """``(key, id, leaf, other)``: the leaf of each row, and where the row is tampered with the leaf after one was added to ``counter``."""
    own = {f: F.col(f"`{f}`") for f in fields}
    changed = own | {counter: own[counter].cast("long") + 1}
    there = tampered(own[order]) & own[counter].isNotNull()
    return docs.select(own[tree].cast("string").alias("key"), own[order].cast("long").alias("id"), F.unhex(leaf_of(own)).alias("leaf"),
                       F.when(there, F.unhex(leaf_of(changed))).alias("other"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, pos, id, leaf, other)``, and the trees as ``(tree, n)``: trees and positions count from 0 in order.

    Rows of one tree may lie in many ranges. What is gathered are counts per range and tree.
    """
    order = [F.col("key").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")]
    ranged = in_tables(rows).repartitionByRange(*order).sortWithinPartitions(*order)  # stored, as ranges are found by a first look at the rows
    nth = F.monotonically_increasing_id()
    held = in_tables(ranged.withColumn("row", nth)).withColumn("part", F.shiftright("row", 33))
    counts = held.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("n"))
    by_key = Window.partitionBy("key").orderBy("part")
    numbered = numbers(keys.select("key", "n"), "key", "tree")
    before = in_tables(counts.withColumn("before", F.sum("n").over(by_key) - F.col("n")).alias("c").join(
        numbered.alias("k"), F.col("c.key").eqNullSafe(F.col("k.key"))).select(
        F.col("part").alias("p"), F.col("c.key").alias("k"), "first", "before", "tree"))
    at = held.join(before, (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k")))
    return at.select("tree", (F.col("before") + F.col("row") - F.col("first")).alias("pos"), "id", "leaf", "other"), numbered.select("tree", "n")


def numbers(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows``, distinct in ``by``, with their rank from 0 by range partitions (null first)."""
    order = F.col(by).asc_nulls_first()
    held = in_tables(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33).alias("__part")
    sizes = held.groupBy(part).agg(F.count("*").alias("__n"))  # one row per range
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    at = held.withColumn("__part", part).join(before, F.col("__part") == F.col("__p"))
    ranked = at.withColumn(name, F.col("__before") + F.col("__row") - F.shiftleft("__part", 33))
    return in_tables(ranked.select(*rows.columns, name))


def h(*parts: bytes) -> bytes:
    """H of digests, which go in as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def reduced(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The nodes of each level from below, ``levels`` times or, with None, until one is left."""
    out = [nodes]
    while len(nodes) > 1 if levels is None else len(out) <= levels:
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way_up(tower: list[list[bytes]], i: int) -> tuple[bytes, list[bytes]]:
    """Sides and siblings of node ``i`` of the lowest level, up to the top."""
    sides, siblings = bytearray(), []
    for nodes in tower[:-1]:
        if i ^ 1 < len(nodes):
            sides.append(LEFT if i & 1 else RIGHT)
            siblings.append(nodes[i ^ 1])
        else:
            sides.append(NONE)
        i >>= 1
    return bytes(sides), siblings


def fold(node: bytes, sides: bytes, siblings: list[bytes]) -> bytes:
    """The root that a node and its proof lead to."""
    rest = iter(siblings)
    for side in sides:
        node = h(node) if side == NONE else h(next(rest), node) if side == LEFT else h(node, next(rest))
    return node


def _split(siblings: bytes) -> list[bytes]:
    return [siblings[i:i + 32] for i in range(0, len(siblings), 32)]


def _levels(last_block: int, levels: int) -> int | None:
    """A tree of one superblock is reduced to its top; of several, each one by all its levels."""
    return levels if last_block else None


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The node above each superblock as a node ``(tree, pos, node)`` of the smaller tree. ``nodes`` also has ``last``, the tree's last position."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        block, last = int(pdf["block"].iloc[0]), int(pdf["last"].iloc[0]) >> levels
        own = pdf.sort_values("pos")["node"].tolist()
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "pos": [block], "node": [reduced(own, _levels(last, levels))[-1][0]], "last": [last]})

    blocks = nodes.withColumn("block", F.shiftright("pos", levels))
    return blocks.groupBy("tree", "block").applyInPandas(reduce, f"{_NODES}, last long")


def ways(nodes: DataFrame, outer: DataFrame | None, levels: int) -> DataFrame:
    """``(tree, pos, sides, siblings, top)`` of all nodes: what leads to the top of everything.

    ``outer`` has the way up of each superblock's top as ``(tree, pos, sides, siblings, top)``; None where superblocks are whole trees.
    """
    def join_(pdf: pd.DataFrame, above: pd.DataFrame | None) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tower = reduced(pdf["node"].tolist(), _levels(int(pdf["last"].iloc[0]) >> levels, levels))
        sides, siblings, top = (b"", b"", tower[-1][0]) if above is None else above[["sides", "siblings", "top"]].iloc[0]
        found = [way_up(tower, i) for i in range(len(pdf))]
        return pd.DataFrame({"tree": pdf["tree"].to_numpy(), "pos": pdf["pos"].to_numpy(), "sides": [s + sides for s, _ in found],
                             "siblings": [b"".join(s) + siblings for _, s in found], "top": top})

    own = nodes.withColumn("block", F.shiftright("pos", levels))
    schema = f"tree long, pos long, {_PATH}, top binary"
    if outer is None:
        return own.groupBy("tree", "block").applyInPandas(lambda pdf: join_(pdf, None), schema)
    return own.groupBy("tree", "block").cogroup(outer.withColumn("block", F.col("pos")).groupBy("tree", "block")).applyInPandas(
        lambda pdf, above: join_(pdf, above), schema)


def climb(nodes: DataFrame, levels: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The way of each node ``(tree, pos, node, last)`` to the top of its tree and, with ``above``, beyond.

    ``above`` turns tops of trees, ``(tree, pos, node, last)`` with position 0, into their ways.
    """
    whole = nodes.where(F.shiftright("last", levels) > 0).isEmpty()
    if whole and above is None:
        return ways(nodes, None, levels)
    smaller = in_tables(tops(nodes, levels))
    outer = above(smaller) if whole else climb(smaller, levels, above)
    return ways(nodes, outer, levels)


def manifest(docs: DataFrame, levels: int = LEVELS, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", tree: str = "lang",
             counter: str = "n_chars") -> DataFrame:
    """Every row with its leaf, its tree's top, the root, its proof's digest, and what its proof says of the row, tampered with or not."""
    placed_rows, trees = placed(leaves(docs, fields, order, tree, counter))
    lasts = trees.select(F.col("tree").alias("t"), (F.col("n") - 1).alias("last"))
    rows = in_tables(placed_rows.join(lasts, F.col("tree") == F.col("t")).drop("t"))
    nodes = rows.select("tree", "pos", F.col("leaf").alias("node"), "last")
    of_trees = trees.agg(F.max("tree")).first()[0]
    if of_trees is None:
        return docs.sparkSession.createDataFrame([], _RESULT)

    def to_root(tree_tops: DataFrame) -> DataFrame:
        """Ways of the trees' tops to the root, as outer nodes of the trees' only superblocks, each with its own hash."""
        as_leaves = tree_tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.lit(of_trees).cast("long").alias("last"))
        found = climb(as_leaves, levels)
        return found.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "sides", "siblings", "top")

    inside = in_tables(tops(nodes, levels))  # the leaves' level is done here: its rows are folded, not returned as nodes
    several = not inside.where("last > 0").isEmpty()
    outer = climb(inside, levels, to_root) if several else to_root(inside)
    inner = rows.withColumns({"block": F.shiftright("pos", levels), "id": F.col("id").cast("string")})  # pandas has no null among whole numbers
    up = outer.withColumn("block", F.col("pos")).select("tree", "block", "sides", "siblings", "top")

    def prove(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        leaf = pdf["leaf"].tolist()
        tower = reduced(leaf, _levels(int(pdf["last"].iloc[0]) >> levels, levels))
        sides, siblings, root = above[["sides", "siblings", "top"]].iloc[0]
        outer_siblings = _split(siblings)
        subroot = fold(tower[-1][0], *_first(sides, outer_siblings, _tree_levels(int(pdf["last"].iloc[0])) - (len(tower) - 1)))
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(leaf, pdf["other"], strict=True)):
            s, hashes = way_up(tower, i)
            hashes = hashes + outer_siblings
            proofs.append(h(*hashes).hex())
            folded.append(fold(own if other is None else other, s + sides, hashes))
        return pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in pdf["id"]], "Int64"), "leaf": [x.hex() for x in leaf], "subroot": subroot.hex(), "root": root.hex(),
                             "proof_sha256": proofs, "folded_root": [x.hex() for x in folded], "verified": np.array([x == root for x in folded], bool)})

    return inner.groupBy("tree", "block").cogroup(up.groupBy("tree", "block")).applyInPandas(prove, _RESULT)


def _tree_levels(last: int) -> int:
    """How often a tree with this last position is halved until one node is left."""
    return last.bit_length()


def _first(sides: bytes, siblings: list[bytes], n: int) -> tuple[bytes, list[bytes]]:
    """The first ``n`` levels of a way."""
    own = sides[:n]
    return own, siblings[:sum(s != NONE for s in own)]


__all__ = ["climb", "fold", "leaf_of", "leaves", "manifest", "placed", "reduced", "tops", "way_up", "ways"]
