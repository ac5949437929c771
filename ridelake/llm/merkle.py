"""Merkle manifest of a table, with block trees in van Emde Boas layout.

The rows of a tree are placed in order without passing a tree through one task (``ranks``). Each aligned run of
2**``edge`` leaves is a block: one task builds its complete subtree and stores the digests in an array in which a
tree is its top half followed by the subtrees below it, recursively. The address of a node comes from arithmetic on (depth,
index) alone, and siblings are read by the same arithmetic. The block roots are the leaves of the next tier, until one
block is left: about log(rows) / ``edge`` tiers. Proofs go the other way: a tier hands each block below it the
siblings above that block's root, so no proof is stored and no digest but a block's own is read.

Digests are lowercase hex SHA-256 of concatenated inputs, digests as hex text; stored as 32 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.ranks import positions
from ridelake.plans.session import cut

EDGE = 12  # a block has 4,096 leaves and 256 KB of digests
BLOCK = "tree string, block long, total long, digest binary, nodes binary"
PATH = "tree string, block long, path binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# --- one block -----------------------------------------------------------------------------------


def digest(*parts: bytes) -> bytes:
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (root: 0) in a complete tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    below, under = levels - top, depth - top
    start = (1 << top) - 1 + (index >> under) * ((1 << below) - 1)
    return start + address(under, index & ((1 << under) - 1), below)


@lru_cache(maxsize=64)
def _addresses(levels: int) -> tuple[np.ndarray, ...]:
    return tuple(address(d, np.arange(1 << d, dtype=np.int64), levels) for d in range(levels))


def height(leaves: int, edge: int, alone: bool) -> int:
    """Edges from a block's root to its leaves: only a block that is its whole tree may be lower than ``edge``."""
    return (leaves - 1).bit_length() if alone else edge


def grow(leaves: list[bytes], high: int) -> np.ndarray:
    """The digests of a block's nodes, one row each by address; places without a node are zero."""
    places = _addresses(high + 1)
    nodes = np.zeros(((2 << high) - 1, 32), np.uint8)
    row = list(leaves)
    for depth in range(high, -1, -1):
        nodes[places[depth][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)] if depth else row
    return nodes


def siblings(nodes: np.ndarray, leaves: int, high: int) -> list[bytes]:
    """For each leaf of a block the digests beside its way up, lowest first; a node without neighbour adds none."""
    places = _addresses(high + 1)
    found: list[list[bytes]] = [[] for _ in range(leaves)]
    index, count = np.arange(leaves, dtype=np.int64), leaves
    for depth in range(high, 0, -1):
        beside = index ^ 1
        there = np.flatnonzero(beside < count)
        data = nodes[places[depth][beside[there]]].tobytes()
        for k, i in enumerate(there.tolist()):
            found[i].append(data[32 * k : 32 * k + 32])
        index, count = index >> 1, (count + 1) >> 1
    return [b"".join(f) for f in found]


def fold(start: bytes, path: bytes, *ways: tuple[int, int]) -> bytes:
    """The root that follows from a digest and the siblings of its way through trees, given as (position, total)."""
    at = 0
    for position, total in ways:
        while total > 1:
            if position ^ 1 < total:
                beside, at = path[at : at + 32], at + 32
                start = digest(beside, start) if position & 1 else digest(start, beside)
            else:
                start = digest(start)
            position, total = position >> 1, (total + 1) >> 1
    return start


def _block_leaves(block: int, total: int, edge: int) -> int:
    return min(1 << edge, total - (block << edge))


# --- the manifest --------------------------------------------------------------------------------


def handed_down(blocks: DataFrame, edge: int) -> DataFrame:
    """For each leaf of the blocks, as a block of the tier below, the siblings above it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree, block, total, nodes, path in frame.itertuples(index=False):
                n = _block_leaves(block, total, edge)
                beside = siblings(np.frombuffer(nodes, np.uint8).reshape(-1, 32), n, height(n, edge, total <= 1 << edge))
                yield pd.DataFrame({
                    "tree": tree, "block": np.arange(n) + (block << edge), "path": [b + bytes(path) for b in beside],
                })

    return blocks.select("tree", "block", "total", "nodes", "path").mapInPandas(run, PATH)


@dataclass
class Forest:
    """Trees with their block tables (``BLOCK``), lowest tier first; ``digest`` is a block's root."""

    leaves: DataFrame  # tree, position, total, digest and what the caller carries
    tiers: list[DataFrame]
    edge: int

    def roots(self) -> DataFrame:
        """tree, digest: one row per tree."""
        tops = [t.where(F.col("total") <= 1 << self.edge).select("tree", "digest") for t in self.tiers]
        return _union(tops)

    def paths(self, tops: DataFrame | None = None) -> DataFrame:
        """The blocks of the lowest tier with the siblings above their roots.

        ``tops`` gives for each tree (tree, path) the siblings above its own root (default: none).
        """
        edge = self.edge
        below = None
        for tier in reversed(self.tiers):
            heads = tier.where(F.col("total") <= 1 << edge).select("tree", "block", F.lit(b"").alias("path"))
            if tops is not None:
                heads = heads.drop("path").join(tops, "tree")
            given = heads if below is None else heads.unionByName(below)
            lit = tier.join(given, ["tree", "block"])
            below = handed_down(lit, edge)
        return lit


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *more = frames
    for frame in more:
        first = first.unionByName(frame)
    return first


def plant(rows: DataFrame, order: list[str], edge: int = EDGE) -> Forest:
    """Trees over ``rows`` (tree, digest, ...), each in ``order``.

    A block is one group of at most 2**``edge`` digests, whatever the size of its tree; an empty table has no trees.
    """
    leaves = cut(positions(rows, ["tree"], order))

    def built(key, frame):
        frame = frame.sort_values("position")
        total = int(frame["total"].iloc[0])
        nodes = grow([bytes(d) for d in frame["digest"]], height(len(frame), edge, total <= 1 << edge))
        return pd.DataFrame({
            "tree": [key[0]], "block": [key[1]], "total": [total], "digest": [nodes[0].tobytes()], "nodes": [nodes.tobytes()],
        })

    tiers, level = [], leaves.select("tree", "position", "total", "digest")
    most = leaves.agg(F.max("total")).first()[0] or 1  # one number
    while True:
        blocks = level.groupBy("tree", F.shiftright("position", edge).alias("block")).applyInPandas(built, BLOCK)
        tiers.append(cut(blocks))
        if most <= 1 << edge:
            return Forest(leaves, tiers, edge)
        most = -(-most >> edge)
        level = tiers[-1].where(F.col("total") > 1 << edge).select(
            "tree", F.col("block").alias("position"),
            F.shiftright(F.col("total") + ((1 << edge) - 1), edge).alias("total"), "digest",
        )


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


@dataclass
class Manifest:
    """``parts``: the trees of the parts over their rows; ``top``: the tree over the parts' roots."""

    parts: Forest
    top: Forest

    def proofs(self) -> DataFrame:
        """Per row: its digest, the roots, the digest of its siblings, and the root that follows from ``claimed``."""
        top, edge = self.top.paths(), self.top.edge
        root = (self.top.roots().first() or [None, None])[1]  # one digest

        upper = handed_down(top, edge).select(F.col("block").alias("position"), "path")
        trees = self.top.leaves.select(
            F.col("part").alias("tree"), "position", F.col("total").alias("n_trees"), F.col("digest").alias("subroot"),
        ).join(upper, "position").withColumnRenamed("position", "tree_at")
        blocks = self.parts.paths(trees.select("tree", "path")).select("tree", "block", "total", "nodes", "path").join(
            trees.drop("path"), "tree"
        )
        low, root = self.parts.edge, bytes(root) if root else b""
        rows = self.parts.leaves.withColumn("block", F.shiftright("position", low))

        def proven(key, mine, block):
            b = block.iloc[0]
            total, subroot = int(b["total"]), bytes(b["subroot"])
            mine = mine.sort_values("position")
            beside = siblings(
                np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32), len(mine), height(len(mine), low, total <= 1 << low)
            )
            upper_path, out = bytes(b["path"]), []
            way = (int(b["tree_at"]), int(b["n_trees"]))
            for doc_id, leaf, claimed, position, own in zip(
                mine["doc_id"].array, mine["digest"], mine["claimed"], mine["position"], beside, strict=True
            ):
                path = own + upper_path
                end = fold(bytes(claimed), path, (position, total), way)
                out.append((
                    None if doc_id is pd.NA or doc_id != doc_id else int(doc_id), bytes(leaf).hex(), subroot.hex(), root.hex(),
                    sha256(path.hex().encode()).hexdigest(), end.hex(), end == root,
                ))
            return pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"doc_id": "Int64"})

        return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(proven, PROOF)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
    part: str = "lang", claimed: Column | None = None, edge: int = EDGE,
) -> Manifest:
    """The manifest of a table: a tree per ``part`` over its rows by ``key``, and a tree over the parts' roots.

    ``claimed`` is the digest of a row as somebody presents it (default: its own), which ``proofs`` folds up to a root. Parts go in the
    byte order of their text, the null part first; it is not the part ''. Within a part null keys come first; rows of one key go by digest, and rows alike
    in everything stand side by side. Other columns are not read.
    """
    own = row_digest(*[F.col(f) for f in fields])
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.when(F.col(part).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(part).cast("string"))).alias("tree"),
        own.alias("digest"), (own if claimed is None else claimed).alias("claimed"),
    )
    parts = plant(rows, ["doc_id", "digest"], edge)
    roots = parts.roots().select(F.lit("").alias("tree"), F.col("tree").alias("part"), "digest")
    return Manifest(parts, plant(roots, ["part"], edge))
