"""Diversity reranking (T8-T12): per user, on at most ``prefilter`` rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import to_number
from tidemark.operators.encoders import as_token
from tidemark.operators.ranking import top_k

PREFILTER = 100
TOP_N = 20


def prefilter(df: DataFrame, k: int = PREFILTER, score: str = "relevance_score") -> DataFrame:
    """The K most relevant rows per user, ties by item keys."""
    return top_k(df, ["user_id"], [F.col(score).desc(), "live_id", "streamer_id"], k)


def _first_places(ranked: DataFrame, pool: int) -> DataFrame:
    """At most ``pool`` rows per user by rank, ties by item keys: what one task may compare pair by pair."""
    ties = [c for c in ("live_id", "streamer_id") if c in ranked.columns]
    return top_k(ranked, ["user_id"], ["rank", *ties], pool, None)


def category_similarity(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Share of equal category values; missing equals missing."""
    total = 0.0
    for values in columns:
        codes = np.unique(values, return_inverse=True)[1]
        total = total + (codes[:, None] == codes[None, :])
    return total / len(columns)


def cosine_similarity(x: np.ndarray) -> np.ndarray:
    """Cosine mapped to [0, 1]."""
    unit = x / np.clip(np.linalg.norm(x, axis=1, keepdims=True), 1e-12, None)
    return (np.clip(unit @ unit.T, -1.0, 1.0) + 1.0) / 2.0


def blended_similarity(
    n: int, categories: Sequence[np.ndarray], numbers: Sequence[np.ndarray], weights: tuple[float, float]
) -> np.ndarray:
    """Weighted mean of the active parts."""
    parts = []
    if categories and weights[0] > 0:
        parts.append((weights[0], category_similarity(categories)))
    if numbers and weights[1] > 0:
        parts.append((weights[1], cosine_similarity(np.column_stack(numbers))))
    if not parts:
        return np.zeros((n, n))
    return np.clip(sum(w * s for w, s in parts) / sum(w for w, _ in parts), 0.0, 1.0)


def _with_sides(ranked: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Similarity inputs next to the rows: categories as text, numbers without gaps.

    The lists are small in bytes but cost Python time, so they keep the full
    parallelism instead of being merged into few partitions.
    """
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked.select(
        "*",
        *[as_token(c).alias(f"_c{i}") for i, c in enumerate(categories)],
        *[to_number(c, "double", 0.0).alias(f"_n{i}") for i, c in enumerate(numbers)],
    ).repartition(parts, "user_id")


def _similarity(rows: pa.Table, n_categories: int, n_numbers: int, weights: tuple[float, float]) -> np.ndarray:
    return blended_similarity(
        rows.num_rows,
        [rows.column(f"_c{i}").to_numpy().astype(str) for i in range(n_categories)],
        [rows.column(f"_n{i}").to_numpy() for i in range(n_numbers)],
        weights,
    )


def _unit(x: np.ndarray) -> np.ndarray:
    low, high = x.min(), x.max()
    return (x - low) / (high - low) if high > low else np.zeros_like(x)


def similarity_profile(
    ranked: DataFrame,
    categories: Sequence[str] = (),
    numbers: Sequence[str] = (),
    weights: tuple[float, float] = (0.7, 0.3),
    pool: int = PREFILTER,
) -> DataFrame:
    """Mean and largest similarity of each listed item to the rest of its user's list.

    All pairs of a list are compared, so only the first ``pool`` places of a user take part.
    """
    ranked = _first_places(ranked, pool)
    n_categories, n_numbers = len(categories), len(numbers)

    def one_user(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        sim = _similarity(rows, n_categories, n_numbers, weights)
        np.fill_diagonal(sim, 0.0)
        return pa.table(
            {
                "user_id": rows.column("user_id"),
                "rank": rows.column("rank"),
                "mean_similarity": sim.sum(axis=1) / max(rows.num_rows - 1, 1),
                "max_similarity": sim.max(axis=1),
            }
        )

    narrow = _with_sides(ranked.select("user_id", "rank", *categories, *numbers), categories, numbers)
    return narrow.groupBy("user_id").applyInArrow(
        one_user, "user_id bigint, rank int, mean_similarity double, max_similarity double"
    )


def mmr(
    ranked: DataFrame,
    trade_off: float = 0.7,
    top_n: int = TOP_N,
    categories: Sequence[str] = (),
    numbers: Sequence[str] = (),
    weights: tuple[float, float] = (0.7, 0.3),
    score: str = "relevance_score",
    pool: int = PREFILTER,
) -> DataFrame:
    """Greedy maximal marginal relevance on the first ``pool`` places of each user.

    Adds ``mmr_score`` and replaces ``rank``; ties go to the smaller incoming rank.
    """
    trade_off = min(max(trade_off, 0.0), 1.0)
    ranked = _first_places(ranked, pool)
    n_categories, n_numbers = len(categories), len(numbers)
    names = list(ranked.columns)
    schema = T.StructType([*ranked.schema.fields, T.StructField("mmr_score", T.DoubleType())])

    def one_user(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        relevance = _unit(rows.column(score).to_numpy().astype(np.float64))
        sim = _similarity(rows, n_categories, n_numbers, weights)
        penalty = np.zeros(rows.num_rows)
        free = np.ones(rows.num_rows, dtype=bool)
        picked, scores = [], []
        for _ in range(min(top_n, rows.num_rows)):
            gain = trade_off * relevance - (1.0 - trade_off) * penalty
            best = int(np.argmax(np.where(free, gain, -np.inf)))
            picked.append(best)
            scores.append(gain[best])
            free[best] = False
            penalty = np.maximum(penalty, sim[:, best]) if len(picked) > 1 else sim[:, best].copy()
        out = rows.select(names).take(pa.array(picked, type=pa.int64()))
        place = pa.array(np.arange(1, len(picked) + 1), type=pa.int32())
        out = out.set_column(names.index("rank"), "rank", place)
        return out.append_column("mmr_score", pa.array(scores, type=pa.float64()))

    return _with_sides(ranked, categories, numbers).groupBy("user_id").applyInArrow(one_user, schema)
