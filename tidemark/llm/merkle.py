"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 12).

Rows are leaves of one binary tree for each language; the trees' roots are the
leaves of a last tree.  Leaves are numbered by range partitioning and cut into
superblocks of ``2 ** LEVELS`` consecutive ones.  Going up, each superblock is
reduced to its own root, and these roots are the leaves of the next tier, until
one node a tree is left.  Going down, a tier's nodes are cogrouped by superblock
with what lies outside of it - the siblings from the superblock's root to the
top, found one tier above - and one function reduces the superblock, joins the
inner and outer part of each proof, and folds each presented leaf up to the
root.  No group holds more than ``2 ** LEVELS`` nodes, and tiers grow with the
logarithm of the rows.

Digests are lowercase hex SHA-256; a node's is that of its children's digests as
text, a lone last node's that of one.  A leaf's covers id, source, language,
length and text, each as byte count, ``:``, value, or ``-`` for null.

Defined cases: rows without a language are a tree of their own, the first; rows
without an id come first in their tree and are never tampered with; rows that
share an id are ordered by leaf, so rows that repeat all fields may change
places without effect; an empty text counts 0 bytes, a null one is ``-``; an
empty table has no rows and no root; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import global_running
from tidemark.session import materialise

#: Levels of a superblock.
LEVELS = 10
#: Rows of one range of the numbering, and the most ranges.
RANGE_ROWS, RANGES = 16_384, 8_192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the five fields of a row."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(nodes: str) -> str:
    return sha256(nodes.encode()).hexdigest()


def levels_of(leaves: list[str], nodes: int) -> list[list[str]]:
    """The levels of one superblock of a tree that has ``nodes`` nodes at this tier, leaves first."""
    out = [leaves]
    while len(out) <= LEVELS and (nodes > 1 << LEVELS or len(out[-1]) > 1):
        last = out[-1]
        out.append([digest("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def inner_path(levels: list[list[str]], at: int) -> tuple[str, str]:
    """Siblings of leaf ``at`` inside its superblock and their sides: left, right, or ``-`` for none."""
    path, sides = [], []
    for level in levels[:-1]:
        other = at ^ 1
        if other < len(level):
            path.append(level[other])
            sides.append("<" if other < at else ">")
        else:
            sides.append("-")
        at >>= 1
    return "".join(path), "".join(sides)


def fold(leaf: str, path: str, sides: str) -> str:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for side in sides:
        sibling = path[at : at + 64] if side != "-" else ""
        at += len(sibling)
        leaf = digest(sibling + leaf if side == "<" else leaf + sibling)
    return leaf


def _reduced(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    nodes = int(block["nodes"].iloc[0])
    top = levels_of(block["digest"].tolist(), nodes)[-1][0]
    above = -(-nodes // (1 << LEVELS))
    return pd.DataFrame({"tree": block["tree"].iloc[:1], "nodes": above, "pos": block["block"].iloc[0], "digest": top})


def _raised(nodes: DataFrame) -> DataFrame:
    """The roots of all superblocks: the nodes of the next tier."""
    blocks = nodes.select("tree", "nodes", "pos", "digest", _block())
    return blocks.groupBy("tree", "block").applyInPandas(_reduced, "tree bigint, nodes bigint, pos bigint, digest string")


def _block() -> Column:
    return F.shiftright("pos", LEVELS).alias("block")


def _proofs(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Each node of a superblock with its whole proof."""
    if block.empty or outer.empty:
        return block.iloc[:0].assign(path="", sides="", subroot="", root="")
    block = block.sort_values("pos").reset_index(drop=True)
    above = outer.iloc[0]
    levels = levels_of(block["digest"].tolist(), int(block["nodes"].iloc[0]))
    inner = [inner_path(levels, i) for i in range(len(block))]
    return block.assign(
        path=[p + above["path"] for p, _ in inner],
        sides=[s + above["sides"] for _, s in inner],
        subroot=above["subroot"],
        root=above["root"],
    )


def _folded(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """As ``_proofs``, each presented leaf folded along its siblings."""
    out = _proofs(block, outer)
    out["proof_sha256"] = [digest(p) for p in out["path"]]
    out["folded_root"] = [fold(*x) for x in zip(out["given"], out["path"], out["sides"])]
    out["verified"] = out["folded_root"] == out["root"]
    return out


_OUTER = "path string, sides string, subroot string, root string"


def _lowered(nodes: DataFrame, outer: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Nodes of a tier met by superblock with the proofs of the superblocks' roots."""
    left = nodes.select("*", _block()).groupBy("tree", "block")
    right = outer.select("tree", F.col("pos").alias("block"), "path", "sides", "subroot", "root").groupBy("tree", "block")
    wanted = [c.split()[0] for c in schema.split(", ")]
    return left.cogroup(right).applyInPandas(lambda a, b: function(a, b)[wanted], schema)


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every tier; ``most`` is the size of the largest tree.  The last tier has one node a tree."""
    out = [nodes]
    while most > 1:
        out.append(materialise(_raised(out[-1])))
        most = -(-most // (1 << LEVELS))
    return out


def _descended(tiers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Proofs of the nodes of the second tier, from those of the trees' roots (tree, pos = 0)."""
    for nodes in tiers[-2:0:-1]:
        outer = materialise(_lowered(nodes, outer, _proofs, f"tree bigint, pos bigint, {_OUTER}"))
    return outer


def manifest(docs: DataFrame, tampered: Column | None = None, paths: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows for which ``tampered`` holds present a leaf with one more in
    ``n_chars``.  ``paths`` adds the siblings (``path``, digests of 64 signs)
    and their ``sides``, with which any row can be proven later.
    """
    fields = {name: F.col(name) for name in FIELDS}
    changed = fields | {"n_chars": F.col("n_chars") + 1}
    bad = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull()
    leaf = leaf_digest(fields)
    leaves = docs.select("lang", "doc_id", leaf.alias("digest"), F.when(bad, leaf_digest(changed)).alias("given"))
    leaves = materialise(leaves)
    kind = docs.schema["doc_id"].dataType.simpleString()
    total, spark = leaves.count(), docs.sparkSession
    result = f"doc_id {kind}, digest string, {_OUTER}, proof_sha256 string, folded_root string, verified boolean"
    ranges = max(RANGE_ROWS, total // RANGES)
    numbered = materialise(global_running(leaves, ["lang", "doc_id", "digest"], {"rank": F.lit(1).cast("bigint")}, ranges))
    trees = numbered.groupBy("lang").agg(F.min("rank_before").alias("first"), F.count(F.lit(1)).alias("nodes"))
    # Languages are numbered by their first rows.
    trees = materialise(global_running(trees, ["first"], {"tree": F.lit(1).cast("bigint")}))
    most, languages = trees.agg(F.max("nodes"), F.count(F.lit(1))).first()
    same = numbered["lang"].eqNullSafe(trees["lang"])
    placed = numbered.join(trees, same).select(
        F.col("tree_before").alias("tree"), "nodes", (F.col("rank_before") - F.col("first")).alias("pos"),
        "doc_id", "digest", F.coalesce("given", "digest").alias("given"),
    )
    tiers = _tiers(placed, max(most or 0, 2))
    subroots = tiers[-1].select(F.lit(0).cast("bigint").alias("tree"), F.lit(languages).cast("bigint").alias("nodes"), F.col("tree").alias("pos"), "digest")
    over = _tiers(materialise(subroots), max(languages, 2))
    top = over[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("sides"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    proofs = _lowered(over[0], _descended(over, top), _proofs, f"pos bigint, digest string, path string, sides string, root string")
    outer = proofs.select(
        F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "path", "sides", F.col("digest").alias("subroot"), "root"
    )
    found = _lowered(placed, _descended(tiers, materialise(outer)), _folded, result)
    columns = ["doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return found.select(*columns, *(["path", "sides"] if paths else []))


def every_seventh() -> Column:
    """Rows whose unsigned crc32 of the decimal id 7 divides."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
