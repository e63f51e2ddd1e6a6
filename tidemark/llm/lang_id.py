"""Language identification with blended-spectrum string kernels (operator 6).

The kernel of two texts is the number of character n-grams, of one to four
letters, that occur in both, divided by the root of the product of their own
numbers; it looks at n-grams that the landmarks contain.  A bounded set of
labelled texts serves as Nystroem landmarks and a bounded sample as rows of a
one-versus-rest kernel ridge regression.  Scoring a batch is a product of its
n-gram presence matrix with the landmarks' and one with the dual weights.
Whole texts are read, in blocks that overlap by three characters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null label are not learned from; without any label every text is
``und``; equal scores go to the language that sorts first.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fold
from tidemark.llm.words import mixed, slices
from tidemark.session import materialise

ORDERS = (1, 2, 3, 4)
HELD_OUT = 2
#: Texts learned from for each language, those with the smallest hashes of their ids, and the landmarks among them.
TRAIN_ROWS = 300
LANDMARKS = 40
RIDGE = 1e-3
#: n-grams in the dense matrices: those with the most landmarks, then the smallest hashes.  The others, each in few
#: landmarks, are counted from lists; where the border lies changes no kernel value.
DENSE = 12_000
TABLE_BITS = 20
BLOCK = 1 << 20
ROWS = 256
_LETTER = re.compile(r"[^\W\d_]")


def _gram_slots(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lower-cased text, with repeats, block by block."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - TABLE_BITS)
    for at in range(0, max(len(points), 1), BLOCK):
        block = points[at : at + BLOCK + max(ORDERS) - 1]
        rolled = np.zeros(len(block), np.uint32)
        for n in ORDERS:
            size = len(block) - n + 1
            if size <= 0:
                break
            rolled = rolled[:size] * np.uint32(0x01000193) + block[n - 1 :] + np.uint32(n)
            yield (rolled * np.uint32(0x9E3779B1)) >> shift


class Model:
    """All n-grams of the landmarks, the landmarks' presence in them, and dual weights."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        per_language = {name: [t for t, l in zip(texts, languages) if l == name] for name in self.languages}
        landmarks = [t for name in self.languages for t in per_language[name][:LANDMARKS]]
        found = [np.unique(np.concatenate([*_gram_slots(text), np.zeros(0, np.uint32)])) for text in landmarks]
        held = np.bincount(np.concatenate(found), minlength=1 << TABLE_BITS)
        slots = np.flatnonzero(held)
        kept = slots[np.lexsort((mixed(slots.astype(np.uint64)), -held[slots]))]
        self.place = np.full(1 << TABLE_BITS, -1, np.int32)
        self.place[kept] = np.arange(len(kept), dtype=np.int32)
        self.grams, self.dense = len(kept), min(len(kept), DENSE)
        self.marks = np.zeros((len(landmarks), self.dense), np.float32)
        places, owners = np.concatenate([self.place[f] for f in found]), np.repeat(np.arange(len(found)), [len(f) for f in found])
        common = places < self.dense
        self.marks[owners[common], places[common]] = 1
        # The landmarks of every other n-gram, one list after the other.
        order = np.argsort(places[~common], kind="stable")
        self.holders = owners[~common][order].astype(np.int32)
        self.starts = np.searchsorted(places[~common][order], np.arange(self.dense, self.grams + 1))
        self.sizes = np.array([len(f) for f in found], np.float64)
        # A kernel row over the landmarks; K(landmarks)^-1/2 turns it into Nystroem coordinates.
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        usable = values > 1e-6 * max(values[-1], 1e-12)
        root = vectors[:, usable] / np.sqrt(values[usable])
        rows = self.kernel(texts) @ root
        wanted = np.array([[l == name for name in self.languages] for l in languages], np.float64)
        gram = rows.T @ rows + RIDGE * len(texts) * np.eye(rows.shape[1])
        # Scores are kernel rows times the dual weights of the landmarks.
        self.dual = root @ np.linalg.solve(gram, rows.T @ wanted)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """A row for each text: its kernel with every landmark."""
        parts = [self._kernel(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.sizes)))

    def _kernel(self, texts: list[str]) -> np.ndarray:
        dense, sizes = np.zeros((len(texts), self.dense), np.float32), np.zeros(len(texts))
        listed = np.zeros((len(texts), len(self.sizes)))
        seen = np.zeros(self.grams + 1, np.bool_)  # the last place stands for all n-grams that no landmark has
        for i, text in enumerate(texts):
            seen[:] = False
            for slots in _gram_slots(text):
                seen[self.place[slots]] = True
            dense[i], rest = seen[: self.dense], np.flatnonzero(seen[self.dense : self.grams])
            sizes[i] = np.count_nonzero(seen[: self.grams])
            counts = self.starts[rest + 1] - self.starts[rest]
            at = np.repeat(self.starts[rest] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            listed[i] = np.bincount(self.holders[at], minlength=len(self.sizes))
        return (dense @ self.marks.T + listed) / np.sqrt(np.maximum(sizes, 1.0)[:, None] * np.maximum(self.sizes, 1.0))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of one-versus-rest scores for each text."""
        return self.kernel(texts) @ self.dual


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, lang) of at most ``rows`` documents of each language outside the held-out fold.

    A threshold on the hash of the id leaves about twice that many candidates,
    however common the language is; only their ids are ranked.
    """
    docs = docs.select("doc_id", "lang", "text")
    usable = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & F.col("doc_id").isNotNull()
        & (fold("doc_id", 4) != HELD_OUT)
    )
    ids = usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("mark"))
    # A stored table of a few rows: Spark sees its size and does not deal the ids by language.
    counts = materialise(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    candidates = ids.join(counts, "lang").where(F.col("mark") / float(1 << 30) < 2.0 * rows / F.col("n"))
    first = Window.partitionBy("lang").orderBy("mark", "doc_id")
    ranked = candidates.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= rows)
    picked = materialise(ranked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_nth"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))
    return usable.join(picked, same).select("lang", "text", "_nth")


def fit(docs: DataFrame) -> Model | None:
    """Model of the bounded sample; None without any label."""
    rows = training_rows(docs).toArrow().sort_by([("lang", "ascending"), ("_nth", "ascending"), ("text", "ascending")])
    usable = [(t, l) for t, l in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist()) if _LETTER.search(t)]
    return Model([t for t, _ in usable], [l for _, l in usable]) if usable else None


def _predict_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = pickle.loads(shared.value)
    for batch in batches:
        filled = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))
        for part in slices(filled):
            texts = part.column("text").to_pylist()
            known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
            names, best = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and known.any():
                found = model.scores([t for t, k in zip(texts, known) if k])
                names[known] = np.array(model.languages, object)[found.argmax(axis=1)]
                best[known] = np.clip(found.max(axis=1), 0.0, 1.0)
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs)))
    rows = docs.select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(lambda batches: _predict_batches(batches, shared), schema)
