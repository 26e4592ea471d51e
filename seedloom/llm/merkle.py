"""A Merkle manifest of a dataset, kept in van Emde Boas blocks.

Leaves are numbered within their tree. Every aligned subtree of 2^``height``
leaves is a block, built by itself; the roots of its blocks are the leaves of
the tree's next layer, up to the layer with one block. A block keeps its
digests in van Emde Boas order: the upper half of its levels first, then each
subtree below it, both in the same order. Where a node lies is arithmetic on
its depth and number, so building and looking up siblings need no pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.operators.numbering import number_within, with_row_id
from seedloom.sources.staging import stage

# Levels of runs in a block: 256 leaves, 511 digests, 32 kB.
HEIGHT = 8
_HEX = 64

_BLOCK = "tree string, size long, block long, nodes binary, root string, ids array<long>, changed array<string>"
_PATH = "tree string, block long, above array<string>, subroot string, root string"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str | bytes) -> str:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode() if isinstance(p, str) else p)
    return h.hexdigest()


def address(levels: int, depth: int, number: np.ndarray | int) -> np.ndarray | int:
    """Where the ``number``-th node of a depth lies among ``2^levels - 1`` in van Emde Boas order."""
    if levels == 1:
        return number * 0
    top = levels // 2
    bottom = levels - top
    if depth < top:
        return address(top, depth, number)
    below = depth - top
    subtree, inside = number >> below, number & ((1 << below) - 1)
    return (1 << top) - 1 + subtree * ((1 << bottom) - 1) + address(bottom, below, inside)


def addresses(levels: int) -> list[list[int]]:
    """The same for all nodes of a block, by depth."""
    return [address(levels, d, np.arange(1 << d)).tolist() for d in range(levels)]


class _Known(dict):
    """Addresses by number of levels, each worked out once in a task."""

    def __missing__(self, levels: int) -> list[list[int]]:
        self[levels] = addresses(levels)
        return self[levels]


def _levels(size: int, height: int) -> int:
    """Levels of a block in a layer of so many leaves: fewer only where it is the whole layer."""
    return 1 + (height if size > 1 << height else max(0, size - 1).bit_length())


def build_block(leaves: list[str], at: list[list[int]]) -> bytes:
    """The digests of a block in van Emde Boas order; nodes that do not exist are blank."""
    nodes = [" " * _HEX] * ((1 << len(at)) - 1)
    for n, leaf in enumerate(leaves):
        nodes[at[-1][n]] = leaf
    count = len(leaves)
    for depth in range(len(at) - 2, -1, -1):
        below = at[depth + 1]
        for n in range((count + 1) // 2):
            pair = [nodes[below[c]] for c in (2 * n, 2 * n + 1) if c < count]
            nodes[at[depth][n]] = digest(*pair)
        count = (count + 1) // 2
    return "".join(nodes).encode()


def path_in_block(nodes: str, n_leaves: int, at: list[list[int]], leaf: int) -> list[str]:
    """Siblings from a leaf up to the block's root.

    ``L`` or ``R`` tells their side; a node without a sibling has an empty step.
    """
    count, steps = n_leaves, []
    for depth in range(len(at) - 1, 0, -1):
        other = leaf ^ 1
        if other < count:
            start = at[depth][other] * _HEX
            steps.append(("L" if other < leaf else "R") + nodes[start : start + _HEX])
        else:
            steps.append("")
        leaf, count = leaf >> 1, (count + 1) // 2
    return steps


def fold(node: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in path:
        node = digest(step[1:], node) if step[:1] == "L" else digest(node, step[1:])
    return node


# --- layers of blocks --------------------------------------------------------


def _blocks(rows: DataFrame, height: int) -> DataFrame:
    """Blocks from ``tree, size, pos, digest`` with ``id`` and ``changed`` of each leaf.

    No more than 2^height rows meet in a group.
    """
    inside = F.struct("pos", "digest", "id", "changed")
    grouped = rows.groupBy("tree", F.shiftright("pos", height).alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(inside)).alias("r")
    )
    flat = grouped.select("tree", "size", "block", *[F.col(f"r.{c}").alias(c) for c in ("digest", "id", "changed")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for batch in batches:
            nodes = [build_block(list(d), known[_levels(s, height)]) for d, s in zip(batch["digest"], batch["size"], strict=True)]
            # The root comes first in this order.
            root = [n[:_HEX].decode() for n in nodes]
            done = batch[["tree", "size", "block"]].assign(nodes=nodes, root=root, ids=batch["id"], changed=batch["changed"])
            yield done

    return flat.mapInPandas(run, _BLOCK)


def _layers(rows: DataFrame, height: int, label: str) -> list[DataFrame]:
    """Layer upon layer of blocks until every tree has one block; each layer is staged."""
    layers = [stage(_blocks(rows, height), label)]
    while True:
        open_trees = layers[-1].filter(F.col("size") > 1 << height)
        if open_trees.isEmpty():
            return layers
        size = F.shiftright(F.col("size") + ((1 << height) - 1), height)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("changed", "string"))]
        up = open_trees.select("tree", size.alias("size"), F.col("block").alias("pos"), F.col("root").alias("digest"), *none)
        layers.append(stage(_blocks(up, height), label))


def _tops(layers: list[DataFrame], height: int) -> DataFrame:
    """``tree, subroot`` of every tree: the root of its only block in a layer."""
    found = [layer.filter(F.col("size") <= 1 << height).select("tree", F.col("root").alias("subroot")) for layer in layers]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _down(blocks: DataFrame, height: int) -> DataFrame:
    """Paths of a layer's leaves, which are the blocks of the layer below.

    ``blocks`` has the path ``above`` its roots; ``subroot`` null means that the
    tree's own root is meant, as its paths start there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for batch in batches:
            rows = []
            for tree, size, block, nodes, ids, above, subroot, root in batch.itertuples(index=False, name=None):
                text, at = nodes.decode(), known[_levels(size, height)]
                for n in range(len(ids)):
                    path = path_in_block(text, len(ids), at, n) + list(above)
                    rows.append((tree, (block << height) + n, path, subroot, root))
            yield pd.DataFrame(rows, columns=["tree", "block", "above", "subroot", "root"])

    return blocks.select("tree", "size", "block", "nodes", "ids", "above", "subroot", "root").mapInPandas(run, _PATH)


def _paths(layers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The lowest layer's blocks with the paths above their roots.

    ``tops`` has ``tree, above, subroot, root``. Each layer is joined with the
    one above by tree and block, two keys that fix one row.
    """
    carried = ["above", "subroot", "root"]
    known = None
    for n in range(len(layers) - 1, -1, -1):
        blocks = layers[n].withColumnRenamed("root", "__own")
        whole = F.col("size") <= 1 << height
        joined = blocks.filter(whole).join(tops.select("tree", *carried), "tree")
        if known is not None:
            rest = blocks.filter(~whole).join(known, ["tree", "block"])
            joined = joined.unionByName(rest.select(*joined.columns))
        known = _down(joined, height) if n else joined
    return known


class Manifest(NamedTuple):
    """Staged layers of blocks, lowest first: of the trees, and of the tree over their roots."""

    trees: list[DataFrame]
    over: list[DataFrame]
    tops: DataFrame
    height: int


def manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``tree, id, digest, changed``; leaves ascend by id, then digest.

    ``tree`` is a string, null for one of its own that comes first, as does a
    null id. ``changed`` is another digest of the leaf to check, or null.
    """
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")))
    numbered = number_within(keyed, ["tree"], [F.col("id").asc_nulls_first(), "digest"], name="pos", size_name="size")
    trees = _layers(numbered, height, "merkle")
    roots = _tops(trees, height)
    # "" comes before any "=..."; Spark compares strings bytewise.
    placed = with_row_id(roots, ["tree"], name="pos")
    n_trees = placed.count()
    rows = placed.select(
        F.lit("").alias("tree"), F.lit(n_trees).cast("long").alias("size"), "pos", F.col("subroot").alias("digest"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"),
    )
    over = _layers(rows, height, "merkle-over")
    own = _tops(over, height).select("tree", F.array().cast("array<string>").alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("subroot").alias("root"))
    down = _down(_paths(over, own, height), height)
    tops = placed.join(down.select(F.col("block").alias("pos"), "above", "root"), "pos")
    return Manifest(trees, over, stage(tops.select("tree", "above", "subroot", "root"), "merkle-tops"), height)


def prove(made: Manifest) -> DataFrame:
    """One row per leaf: its path's digest, and the root that it, or what it changed to, folds up to."""
    height = made.height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known()
        for batch in batches:
            for size, nodes, ids, changed, above, subroot, root in batch.itertuples(index=False, name=None):
                text, at, above = nodes.decode(), known[_levels(size, height)], list(above)
                tail = "".join(s[1:] for s in above)
                folded, rows = {}, []
                for n, (i, other) in enumerate(zip(ids, changed, strict=True)):
                    leaf = text[at[-1][n] * _HEX : (at[-1][n] + 1) * _HEX]
                    path = path_in_block(text, len(ids), at, n)
                    node = fold(leaf if other is None else other, path)
                    if node not in folded:
                        folded[node] = fold(node, above)
                    up = folded[node]
                    proof = digest("".join(s[1:] for s in path), tail)
                    rows.append((i, leaf, subroot, root, proof, up, up == root))
                done = pd.DataFrame(rows, columns=[c.split()[0] for c in _PROVED.split(", ")])
                yield done.astype({"doc_id": "Int64"})

    blocks = _paths(made.trees, made.tops, height)
    return blocks.select("size", "nodes", "ids", "changed", "above", "subroot", "root").mapInPandas(run, _PROVED)


# --- the leaves of documents -------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def document_leaves(documents: DataFrame) -> DataFrame:
    """``tree, id, digest, changed`` of documents; ``changed`` where the digest of the id says so.

    In the changed version ``n_chars`` is one more; a null stays null, and a
    null doc_id is never changed.
    """

    def leaf(n_chars: Column) -> Column:
        parts = [_field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]
        return F.sha2(F.concat(*parts), 256)

    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return documents.select(
        F.col("lang").cast("string").alias("tree"),
        F.col("doc_id").cast("long").alias("id"),
        leaf(F.col("n_chars")).alias("digest"),
        F.when(tampered, leaf(F.try_add("n_chars", F.lit(1)))).alias("changed"),
    )


def document_proofs(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Each document's leaf, proof and check against the root of the whole table.

    Trees are the values of ``lang``, null being one of its own. Null ids come
    first; rows of one id come by digest, and equal rows are leaves of their
    own. Texts are read once; what follows moves digests. An empty table gives
    no rows. Only the counts of open trees and of trees come to the driver.
    """
    leaves = stage(document_leaves(documents), "leaves")
    return prove(manifest(leaves, height))
