"""SimHash near-duplicates by pigeonring filtering (operator 8).

Fingerprints of 64 bits over word shingles link at two or fewer differing
bits; documents that links connect form a group, named by its smallest id.

Finding links works on distinct fingerprints.  Cut into m = 4 segments, two
fingerprints within tau = 2 bits have, by the pigeonring principle, a segment
from which on every chain of l consecutive segments differs in at most
l * tau / m bits: 0, 1, 1, 2.  Such a chain holds its first segment unchanged
and one of the next two, so equality of a pair of segments (six pairs) finds
every candidate; the chain budgets prune them, and the full Hamming distance
decides.

A pair of segments that very many fingerprints share is not expanded into all
their pairs.  There each fingerprint meets the others at its hubs, the values
within one bit of it: two fingerprints share a hub exactly if they are within
two bits.  A hub holds at most 65 fingerprints, and each links to the smallest
of them, which keeps every group connected.

Defined cases: a null text is an empty one; a text without words has
fingerprint zero; fewer words than a shingle make one shingle of them all; a
group of rows without ids has no name (null); repeated rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, row_digest, rows_of, text_of
from tidemark.llm.components import components
from tidemark.session import materialise

SHINGLE = 3
SEED = 42
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
TAU = 2
#: Buckets up to this size are expanded into pairs, larger ones meet at hubs; both find every link.
PAIRED = 32
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # ASCII letters and white space only, as the contract says
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        block = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in block], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        bits = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bits) of every document, the fingerprint as a signed 64-bit number."""
    texts = docs.select("doc_id", text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda batches: _fingerprint_batches(batches, shingle), f"doc_id {kind}, bits bigint")


def segment(bits: Column, i: int) -> Column:
    return F.shiftrightunsigned(bits, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("bigint"))


def segment_pairs(bits: Column) -> Column:
    """The six pairs of segments as (pair number, both values in one number)."""
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    return F.array(
        *[
            F.struct(F.lit(p).alias("pair"), (segment(bits, i) * (1 << WIDTH) + segment(bits, j)).alias("value"))
            for p, (i, j) in enumerate(pairs)
        ]
    )


def ring_filter(left: Column, right: Column) -> Column:
    """Some segment starts chains that all keep within l * TAU / SEGMENTS differences."""
    differ = left.bitwiseXOR(right)
    found = F.lit(False)
    for start in range(SEGMENTS):
        within, total = F.lit(True), F.lit(0)
        for length in range(1, SEGMENTS):
            total = total + F.bit_count(segment(differ, start + length - 1))
            within = within & (total <= length * TAU // SEGMENTS)
        found = found | within
    return found


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``bits`` that connect every group; ``classes`` is a stored table."""
    keyed = classes.select("bits", F.explode(segment_pairs(F.col("bits"))).alias("key")).select("bits", "key.*")
    sizes = keyed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("size"))
    sized = materialise(attach(keyed, materialise(sizes), ["pair", "value"], "size", ["size"]))
    small = sized.where((F.col("size") > 1) & (F.col("size") <= PAIRED)).select("pair", "value", "bits")
    left, right = small.withColumnRenamed("bits", "a"), small.withColumnRenamed("bits", "b")
    pairs = left.join(right, ["pair", "value"]).where(F.col("a") < F.col("b")).select("a", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU
    paired = pairs.where(ring_filter(F.col("a"), F.col("b"))).where(near)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint") for b in range(64)])
    crowded = sized.where(F.col("size") > PAIRED).select("bits").distinct()
    hubs = crowded.select("bits", F.explode(flips).alias("flip")).groupBy(
        F.col("bits").bitwiseXOR(F.col("flip")).alias("hub")
    )
    met = hubs.agg(F.collect_list("bits").alias("members")).where(F.size("members") > 1)
    starred = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return paired.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = materialise(fingerprints(docs, shingle))
    classes = materialise(
        rows.groupBy("bits").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    )
    groups = components(links(classes))
    named = classes.join(groups, classes["bits"] == groups["node"], "left").select(
        "bits", "first_id", "size", F.coalesce("root", "bits").alias("root")
    )
    named = materialise(named)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = materialise(named.join(smallest, "root").select("bits", "size", "component_id"))
    found = attach(rows, table, ["bits"], "size", ["component_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): row digests of the groups, stored: the smallest one of each group with every other one of it.

    The pairs name the groups.  Whoever holds rows against another measure has to hold all rows of a group against each
    other: two near fingerprints need not meet in a pair.
    """
    grouped = near_duplicates(docs.select(row_digest().alias("doc_id"), "text"), shingle)
    pairs = grouped.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return materialise(pairs.where("a < b").distinct())


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, all columns: the smallest id's, rows without an id last.

    Different texts under one id are judged on their own, and of those in one
    group the row with the smallest digest stays; rows that repeat id and text
    are one row.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row_digest().alias("row"))
    grouped = near_duplicates(docs.select(order.alias("doc_id"), "text"), shingle)
    return rows_of(docs, grouped.select("component_id.row").distinct())
