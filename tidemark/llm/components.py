"""Connected components of a link table.

Links are first contracted where they lie: each partition replaces its links by
stars around the smallest node of each of its local groups.  Stars of different
partitions are then joined by alternating large and small stars, contracting
again after each round, until every node hangs on one root that hangs on
nothing.  Rounds grow with the logarithm of the longest chain of local groups;
few links lie in one partition and need none.  A node with very many links is
looked up by ``attach``, so it is never the work of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach
from tidemark.session import materialise


def local_roots(one: np.ndarray, other: np.ndarray, nodes: int) -> np.ndarray:
    """Smallest node of each node's group, nodes being numbers below ``nodes``."""
    root = np.arange(nodes)
    while True:
        low = np.minimum(root[one], root[other])
        before = root.copy()
        # The roots of both ends move, and with them all that hangs on them.
        np.minimum.at(root, before[one], low)
        np.minimum.at(root, before[other], low)
        np.minimum.at(root, one, low)
        np.minimum.at(root, other, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars (u, v), v being the smallest node of u's local group."""
    parts = list(batches)
    if not parts:
        return
    u, v = (pa.concat_arrays([b.column(name) for b in parts]) for name in ("u", "v"))
    both = pa.concat_arrays([u, v])
    values = np.array(both.to_pylist(), object) if pa.types.is_string(both.type) else both.to_numpy()
    names, codes = np.unique(values, return_inverse=True)  # sorted, so the smallest number is the smallest name
    root = local_roots(codes[: len(u)], codes[len(u) :], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    arrays = [pa.array(names[moved].tolist(), both.type), pa.array(names[root[moved]].tolist(), both.type)]
    yield pa.RecordBatch.from_arrays(arrays, ["u", "v"])


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, without repeats, as stored local stars."""
    kind = links.schema["u"].dataType.simpleString()
    return materialise(links.distinct().mapInArrow(_contract, f"u {kind}, v {kind}"))


def _nearest(arcs: DataFrame) -> DataFrame:
    """(u, v, m): every arc with the smallest end of its node's arcs."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return attach(arcs, materialise(least), ["u"], "n", ["m"])


def _all_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on another node."""
    hanging = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    roots = links.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(1))
    return hanging.join(roots, "u", "left").where("n > 1 or root = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being the smallest node that it reaches."""
    links = _contracted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while not _all_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(materialise(both)).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # Each arc goes from the larger to the smaller node here.
        small = _nearest(materialise(large.distinct()))
        arcs = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("arc"))
        links = _contracted(arcs.select("arc.*").where("u <> v"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
