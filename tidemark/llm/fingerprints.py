"""Document fingerprints by consistent weighted sampling (operator 4).

A text is the bag of its lower-cased words, each weighted with its count.  For
sample k every word draws r and c from a Gamma(2, 1) distribution and b from
(0, 1), all from hashes of the word, so they are the same in every text.  With
t = floor(ln(weight) / r + b), the word of the smallest
ln(c) - r (t - b) - r and its t are the sample.  Two texts' k-th samples are
equal with the probability of their generalised Jaccard similarity, the sum of
the smaller over the sum of the larger weights, so the share of equal samples
estimates it.

A fingerprint is SAMPLES numbers of 16 bits in hexadecimal.  Defined cases: a
null text is an empty one; texts without words share the fingerprint of zeros;
equal texts have equal fingerprints; repeated rows are each reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.words import hashes, mixed, slices, words_of
from tidemark.operators.skew import split_points

SAMPLES = 64
#: Rows of one range of ids, worked on in order.
RANGE_ROWS = 4_000
#: More ranges than this only grow longer; they are sorted on disk and walked in order.
RANGES = 65_536
_GOLDEN = 0x9E3779B97F4A7C15
_LOW21, _LOW32 = np.uint64((1 << 21) - 1), np.uint64((1 << 32) - 1)


def _uniform(bits: np.ndarray, width: int) -> np.ndarray:
    return ((bits.astype(np.float32)) + np.float32(0.5)) * np.float32(2.0**-width)


def _draws(words: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of each word for one sample, from 128 hashed bits."""
    first, second = (mixed(words + np.uint64(_GOLDEN * i % 2**64)) for i in (2 * sample + 1, 2 * sample + 2))
    r = -np.log(_uniform(first & _LOW21, 21) * _uniform((first >> np.uint64(21)) & _LOW21, 21))
    b = _uniform(first >> np.uint64(43), 21)
    c = -np.log(_uniform(second & _LOW32, 32)) - np.log(_uniform(second >> np.uint64(32), 32))
    return r, np.log(c), b


def _sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the floats."""
    bits = values.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def signatures(texts: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit numbers for each text."""
    words = words_of(texts)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(words.codes):
        return out
    size = len(words.dictionary)
    cells, weights = np.unique(words.owners * size + words.codes, return_counts=True)
    owners, terms = np.divmod(cells, size)
    filled, starts = np.unique(owners, return_index=True)
    keys = hashes(words.dictionary)
    heavy = np.flatnonzero(weights > 1)
    logs, terms_of_heavy = np.log(weights[heavy]).astype(np.float32), terms[heavy]
    names = (keys >> np.uint64(16)) & _LOW32
    for k in range(samples):
        r, c, b = _draws(keys, k)
        # Weight one has t = 0; a cell is (value, word and t) in one number, so one minimum finds both.
        single = (_sortable(c + r * b - r) << np.uint64(32)) | names
        packed = single[terms]
        rh, bh = r[terms_of_heavy], b[terms_of_heavy]
        t = np.floor(logs / rh + bh)
        value = c[terms_of_heavy] - rh * (t - bh) - rh
        name = mixed(keys[terms_of_heavy] + t.astype(np.uint64)) & _LOW32
        packed[heavy] = (_sortable(value) << np.uint64(32)) | np.where(t == 0, names[terms_of_heavy], name)
        best = np.minimum.reduceat(packed, starts)
        out[filled, k] = ((best ^ (best >> np.uint64(16))) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (left == right).mean(axis=1)


def _hex(rows: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in rows]


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = pa.array(_hex(signatures(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.mapInArrow(_signature_batches, f"doc_id {kind}, fingerprint string")


def in_order(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text, area, extra): documents in ranges of falling ids, each range followed by its successor's first row.

    A range is one area, sorted; the row marked ``extra`` belongs to the next
    area (after the last one, to the first) and closes this one.  Ranges are
    cut at a bounded sample of the ids, and one id per range comes back.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    ids = rows.select("doc_id").where(F.col("doc_id").isNotNull())
    parts = min(max(ids.count() // range_rows, 1), RANGES)
    cuts = [c[0] for c in split_points(ids, ["doc_id"], parts)] if parts > 1 else []
    place = F.lit(0)
    if cuts:
        edges = np.array(cuts)
        place = F.pandas_udf(lambda v: pd.Series(edges.searchsorted(v, "right")).astype("int32"), "int")(
            F.coalesce("doc_id", F.lit(cuts[0]))
        )
    placed = rows.withColumn("area", F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(-place))
    firsts = placed.groupBy("area").agg(F.max("doc_id").alias("first_id")).orderBy("area").collect()
    receivers = [firsts[i - 1]["area"] for i in range(len(firsts))]
    known = [(f["first_id"], r) for f, r in zip(firsts, receivers) if f["first_id"] is not None]
    empty = [r for f, r in zip(firsts, receivers) if f["first_id"] is None]
    schema = f"_id {docs.schema['doc_id'].dataType.simpleString()}, _area int"
    spark = docs.sparkSession
    # One row per range.
    heads = rows.join(F.broadcast(spark.createDataFrame(known, schema)), F.col("doc_id") == F.col("_id")).drop("_id")
    if empty:  # the rows without ids are the last area
        heads = heads.unionByName(rows.where(F.col("doc_id").isNull()).withColumn("_area", F.lit(empty[0])))
    # Of repeated ids the smallest text comes first.
    heads = heads.groupBy("_area").agg(F.min(F.struct("text", "doc_id")).alias("head"))
    heads = heads.select("head.doc_id", "head.text", F.col("_area").alias("area"), F.lit(True).alias("extra"))
    everything = placed.withColumn("extra", F.lit(False)).unionByName(heads)
    # Areas run from -len(cuts) to 0, and 1 for rows without ids.
    dealt = everything.repartitionById(len(cuts) + 2, (F.col("area") + len(cuts)).cast("int"))
    return dealt.sortWithinPartitions("area", "extra", F.desc_nulls_last("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple], following: tuple) -> pa.RecordBatch:
    """Results of consecutive rows; ``following`` is the row after the last."""
    texts = [r[1] for r in rows] + [following[1]]
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
    own = signatures(pa.array(texts, pa.string()))
    other = signatures(pa.array(edited, pa.string()))
    sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    columns = {
        "doc_id": [r[0] for r in rows],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": sha,
        "fingerprint": _hex(own[:-1]),
        "edited_fingerprint": _hex(other),
        "near_edited": likeness(own[:-1], other),
        "near_next": likeness(own[:-1], own[1:]),
    }
    return pa.RecordBatch.from_pydict(columns)


def _compare_batches(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Walks the sorted rows; the last row of a slice waits for its successor."""
    waiting: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out = _compared(rows[:-1], rows[-1])
        return out.set_column(0, "doc_id", out.column(0).cast(kind))

    for batch in batches:
        for part in slices(batch):
            columns = [part.column(c).to_pylist() for c in ("doc_id", "text", "area", "extra")]
            for row in zip(*columns):
                waiting.append(row)
                if row[3]:  # the area is complete
                    if len(waiting) > 1:
                        yield flush(waiting)
                    waiting = []
            if len(waiting) > 1:
                yield flush(waiting)
                waiting = waiting[-1:]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with how alike they and the next document's are."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, "
        "fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return in_order(docs).mapInArrow(lambda batches: _compare_batches(batches, kind), schema)
