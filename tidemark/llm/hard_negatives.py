"""Hard negatives by exact inner products from Four-Russians tables (operator 13).

Components become whole numbers, ``floor(scale * x)``.  A candidate is stored as
bit planes: for every plane one bit of each component, eight components packed
into a byte.  For an anchor, the sums of all 256 subsets of each group of eight
components are tabled once; a plane's part of the inner product is then one
lookup for each group, and planes are added with their weights (the sign plane
with a negative one).  The scores are exact.

Candidates are cut into runs and anchors into parts, and each cell of this grid
is one group of a bounded size, which returns only the first rows of each of its
anchors.  A first pass finds the anchors' positives, a second one, for the score
window of each positive, its negatives.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; so do rows with a component beyond 2 ** 24 after
scaling, whose products could leave 64 bits; a shorter vector counts as filled
up with zeros; of ties the smaller id is first, null ids last; a row is never a
positive or a negative of its own id; of rows that share an anchor's id the one
with the smallest label and vector asks, while all are candidates; a positive
below zero has no window; an empty table gives no rows; other columns play no
part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores at least this share of its positive, in hundredths.
LEAST = 80
LIMIT = 1 << 24
#: A cell holds between these numbers of candidates and of anchors; small inputs are cut finer to keep all cores busy.
RUNS, PARTS = (4_096, 65_536), (128, 8_192)
#: Anchors tabled and candidates scored at a time.
TABLED, SCORED = 128, 4_096
_NONE = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    v = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("int"))
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < LIMIT, F.lit(False)))
    usable = F.col("label").isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))
    return rows.where(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("v")
    )


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """The vectors as rows, filled up with zeros to a multiple of eight."""
    lengths = np.diff(vectors.offsets.to_numpy())
    width = -(-max(int(lengths.max(initial=0)), 1) // 8) * 8
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def planes_of(vectors: np.ndarray) -> np.ndarray:
    """Bit planes (planes, rows, width / 8) in two's complement; the last plane is the sign."""
    count = int(np.abs(vectors).max(initial=1)).bit_length() + 1
    out = [np.packbits(((vectors >> i) & 1).astype(np.uint8), axis=1, bitorder="little") for i in range(count)]
    return np.stack(out)


def tables_of(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(width / 8, 256, anchors): sums of every subset of each group of eight components."""
    groups = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    out = np.zeros((len(groups), 256, len(anchors)), kind)
    for i in range(8):  # subsets with component i are those without it, plus the component
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + groups[:, i : i + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors): exact inner products."""
    out = np.zeros((planes.shape[1], tables.shape[2]), tables.dtype)
    for i, plane in enumerate(planes):
        part = np.zeros_like(out)
        for g in range(min(len(tables), plane.shape[1])):
            part += np.take(tables[g], plane[:, g], axis=0)
        part <<= i
        if i == len(planes) - 1:
            out -= part
        else:
            out += part
    return out


def narrowest(anchors: np.ndarray, planes: np.ndarray) -> type:
    """The integer type that no partial score leaves."""
    most = int(np.abs(anchors).max(initial=1)) * anchors.shape[1] << len(planes)
    return np.int32 if most < 1 << 31 else np.int64


def first_places(score: np.ndarray, ids: np.ndarray, take: int) -> np.ndarray:
    """Places of the first ``take`` rows with a score: higher scores, then smaller ids; the largest id stands for null."""
    places = np.flatnonzero(score != _NONE)
    if len(places) > 4 * take:  # rows below the take-th score cannot be among them
        bound = np.partition(score[places], len(places) - take)[len(places) - take]
        places = places[score[places] >= bound]
    return places[np.lexsort((ids[places], -score[places]))][:take]


_NULL_ID = np.iinfo(np.int64).max
_FOUND = "anchor_id bigint, bound bigint, found_id bigint, score bigint"


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    rows = rows.combine_chunks()
    ids = rows.column("vec_id").fill_null(_NULL_ID).to_numpy()
    return ids, rows.column("label").to_numpy(), rows.column("v").chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int32()))


def _cell(candidates: pa.Table, anchors: pa.Table, windows: bool) -> pa.Table:
    """The first rows of each anchor (and window) among the candidates of one cell."""
    best: dict[tuple, list] = {}
    take = NEGATIVES if windows else POSITIVES
    if candidates.num_rows and anchors.num_rows:
        a_ids, a_labels, a_vectors = _columns(anchors)
        bounds = anchors.column("bounds").to_pylist() if windows else None
        blocks = [_columns(candidates.slice(at, SCORED)) for at in range(0, candidates.num_rows, SCORED)]
        blocks = [(ids, labels, planes_of(matrix_of(v))) for ids, labels, v in blocks]
        for at in range(0, len(a_ids), TABLED):
            vectors = matrix_of(a_vectors.slice(at, TABLED))
            for ids, labels, planes in blocks:
                tables = tables_of(vectors, narrowest(vectors, planes))
                found = scores(tables, planes)
                for j in range(len(vectors)):
                    anchor = int(a_ids[at + j])
                    same = labels == a_labels[at + j]
                    score = np.where((ids != anchor) & (~same if windows else same), found[:, j].astype(np.int64), _NONE)
                    for bound in bounds[at + j] if windows else [None]:
                        one = score
                        if windows:
                            one = np.where((score <= bound) & (score >= -(-LEAST * bound // 100)), score, _NONE)
                        rows = [(-int(one[i]), int(ids[i])) for i in first_places(one, ids, take)]
                        if rows:
                            best[anchor, bound] = heapq.nsmallest(take, best.get((anchor, bound), []) + rows)
    rows = [(a, b, None if i == _NULL_ID else i, -s) for (a, b), found in best.items() for s, i in found]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=names)


def _cuts(rows: int, least: int, most: int, wanted: int) -> int:
    return max(-(-rows // min(max(rows // wanted, least), most)), 1)


def _each(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _met(candidates: DataFrame, anchors: DataFrame, windows: bool) -> DataFrame:
    """(anchor_id, bound, found_id, score): the first rows of each anchor in every cell."""
    runs, parts = _cuts(candidates.count(), *RUNS, 16), _cuts(anchors.count(), *PARTS, 4)
    # By place, so that copies of one row are spread; stored, so that a row keeps its run.
    run = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(runs)).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    left = materialise(candidates.withColumn("run", run)).select("*", _each(parts).alias("part"))
    right = anchors.withColumn("part", part).select("*", _each(runs).alias("run"))
    cells = left.groupBy("run", "part").cogroup(right.groupBy("run", "part"))
    return cells.applyInArrow(lambda a, b: _cell(a, b, windows), _FOUND)


def _ranked(found: DataFrame, by: list[str], take: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)


def hard_negatives(rows: DataFrame, is_anchor: Column, vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``is_anchor`` holds."""
    candidates = materialise(whole_vectors(rows, vector))
    asking = candidates.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull())
    anchors = asking.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("one"))
    anchors = materialise(anchors.select("vec_id", "one.label", "one.v"))
    positives = materialise(_ranked(_met(candidates, anchors, False), ["anchor_id"], POSITIVES))
    bounds = positives.where("score >= 0").groupBy("anchor_id").agg(F.collect_set("score").alias("bounds"))
    windowed = anchors.join(bounds, anchors["vec_id"] == bounds["anchor_id"]).drop("anchor_id")
    negatives = _ranked(_met(candidates, materialise(windowed), True), ["anchor_id", "bound"], NEGATIVES)
    asked = positives.select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives = negatives.select(
        F.col("anchor_id").alias("_of"), "bound", F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"),
    )
    met = asked.join(negatives, (asked["anchor_id"] == negatives["_of"]) & (asked["positive_score"] == negatives["bound"]))
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """The next label for every seventh id, as the query asks."""
    seventh = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    return rows.withColumn("label", F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")))
