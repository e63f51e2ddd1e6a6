"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL (operator 7).

Features are single words and pairs of neighbours, hashed: once the words
themselves, once their shapes (runs of capitals, small letters and digits, other
characters as they are, and a mark where a word repeats its neighbour), and how
much of the text repeats earlier words of it.  A feature's value is its share
of the text, so long and short texts compare.  Weights are found by
follow-the-regularised-leader steps over a bounded sample of labelled rows; a
score is the logistic of a sparse dot product over the whole text.

Defined cases: a null or empty text has no word features and gets the score of
the intercept; a document that is labelled more than once counts with the mean
of its labels; without any usable label every score is 0.5.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, text_of, whole_texts
from tidemark.llm.words import Words, hashes, mixed, slices, words_of

BITS = 18
#: Labelled documents that the classifier is fitted on: those with the smallest hashes of their ids.
TRAIN_ROWS = 4_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Shares of a text are small numbers: a scale that lets one step move the score.
SCALE = 8.0
THRESHOLD = 0.7
HELD_OUT = 2
#: Text that is worked on at once: its features take some sixty times as much memory.
SLICE_BYTES = 1_000_000
_GROUPS = (b"[A-Z]+", b"[a-z\x80-\xff]+", b"[0-9]+")
_SAME = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: bytes) -> bytes:
    """Runs of capitals, small or other letters, and digits as one sign each."""
    return _shape_of(word) if len(word) <= 64 else _shape_of.__wrapped__(word)


@functools.lru_cache(maxsize=200_000)
def _shape_of(word: bytes) -> bytes:
    word = re.sub(_GROUPS[1], b"a", re.sub(_GROUPS[0], b"A", word))
    return re.sub(_GROUPS[2], b"9", word)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature, value) of every feature occurrence; the intercept is feature 0 of each text."""
    words = words_of(texts, lower=False)
    lowered = hashes(pa.array([w.lower() for w in words.dictionary.cast(pa.binary()).to_pylist()], pa.binary()), 1)
    shapes = [_shape(w) for w in words.dictionary.cast(pa.binary()).to_pylist()]
    shaped = hashes(pa.array(shapes, pa.binary()), 2)
    owners, codes = words.owners, words.codes
    sizes = words.counts.astype(np.float64)
    follows = np.zeros(len(codes), bool)
    follows[1:] = owners[1:] == owners[:-1]
    repeats = np.zeros(len(codes), bool)
    repeats[1:] = follows[1:] & (codes[1:] == codes[:-1])
    streams = []
    for single in (lowered[codes], np.where(repeats, _SAME, shaped[codes])):
        streams.append((owners, single))
        pair = mixed(single[:-1] * np.uint64(3) + single[1:])
        streams.append((owners[1:][follows[1:]], pair[follows[1:]]))
    size = np.uint64((1 << BITS) - 64)
    parts = [(o, (mixed(h + np.uint64(i)) % size).astype(np.int64) + 64, SCALE / sizes[o]) for i, (o, h) in enumerate(streams)]
    everyone = np.arange(len(texts))
    parts.append((everyone, np.zeros(len(texts), np.int64), np.ones(len(texts))))
    parts.append((everyone, 1 + _repeated(words), np.ones(len(texts))))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _repeated(words: Words) -> np.ndarray:
    """Of each text, the share of its five-word runs that it has already had, in sixteenths."""
    if len(words.codes) < 5:
        return np.zeros(len(words.counts), np.int64)
    codes = words.codes.astype(np.uint64)
    run = np.zeros(len(codes) - 4, np.uint64)
    for i in range(5):
        run = mixed(run + codes[i : len(codes) - 4 + i] + np.uint64(i))
    owners = words.owners
    inside = owners[:-4] == owners[4:]
    owners, run = owners[:-4][inside], run[inside]
    order = np.lexsort((run, owners))
    again = (owners[order][1:] == owners[order][:-1]) & (run[order][1:] == run[order][:-1])
    total = np.bincount(owners, minlength=len(words.counts))
    seen = np.bincount(owners[order][1:][again], minlength=len(words.counts))
    return np.ceil(15 * seen / np.maximum(total, 1)).astype(np.int64)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's rows with their features folded to (feature, value) lists."""
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            owner, feature, value = _features(part.column("text"))
            keys, place = np.unique(owner * (1 << BITS) + feature, return_inverse=True)
            totals = np.bincount(place, value)
            cuts = np.searchsorted(keys >> BITS, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in ((keys & ((1 << BITS) - 1)).astype(np.int32), totals.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("label"), *lists], ["mark", "label", "features", "amounts"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(mark, label, features, amounts) of at most ``rows`` labelled documents outside the held-out fold.

    Labels of other documents do not count towards ``rows``.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != HELD_OUT))
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = usable.select("doc_id", F.col(label).alias("label")).groupBy("doc_id").agg(F.avg("label").alias("label"))
    picked = picked.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("mark"), (F.col("label") >= 0.5).cast("double").alias("label"))
    picked = picked.orderBy("mark", "_id").limit(rows)
    # At most ``rows`` rows of three numbers.
    found = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    kept = found.select("mark", "label", "text")
    return kept.mapInArrow(_feature_batches, "mark bigint, label double, features array<int>, amounts array<float>")


def train(rows: pa.Table, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal steps over the sample, in the order of the ids' hashes."""
    total, squares = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = rows.sort_by("mark")
    label = rows.column("label").to_numpy()
    examples = [(f.values.to_numpy(), v.values.to_numpy().astype(np.float64)) for f, v in zip(rows.column("features"), rows.column("amounts"))]

    def weights(at) -> np.ndarray:
        z, n = total[at], squares[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for y, (feature, value) in zip(label, examples):
            w = weights(feature)
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            step = (np.sqrt(squares[feature] + gradient**2) - np.sqrt(squares[feature])) / ALPHA
            total[feature] += gradient - step * w
            squares[feature] += gradient**2
    return weights(slice(None)).astype(np.float32)


def _score_batches(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE_BYTES):
            owner, feature, value = _features(part.column("text"))
            margin = np.bincount(owner, weights.value[feature] * value, minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            others = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*others.columns, pa.array(score)], [*others.schema.names, "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    docs = whole_texts(docs)
    weights = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs, labels, label).toArrow()))
    rows = docs.select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(lambda batches: _score_batches(batches, weights), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep_batches(batches: Iterator[pa.RecordBatch], weights, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("text")
        for part in slices(batch.set_column(place, "text", batch.column(place).fill_null("")), limit=SLICE_BYTES):
            owner, feature, value = _features(part.column(place))
            margin = np.bincount(owner, weights.value[feature] * value, minlength=part.num_rows)
            score = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield part.filter(pa.array(score >= threshold))


def of_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, all columns; a kept null text stays as an empty one.

    Where no document has a usable label, nothing is learned and all documents are kept.
    """
    docs = whole_texts(docs)
    learned = training_rows(docs, labels, label).toArrow()
    if not learned.num_rows:
        return docs.withColumn("text", text_of())
    weights = docs.sparkSession.sparkContext.broadcast(train(learned))
    return docs.mapInArrow(lambda batches: _keep_batches(batches, weights, threshold), docs.schema)
