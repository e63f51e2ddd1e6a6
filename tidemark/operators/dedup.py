"""Keyed de-duplication as mergeable aggregates.

``min_by`` keeps one candidate per key in every map task, so a key with very
many copies costs one row per task in the shuffle and needs no sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["live_id", "streamer_id", "user_id"]


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key; ``order`` ends with a unique column."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_row(df: DataFrame, keys: Sequence[str], time_us: str, row_id: str) -> DataFrame:
    """Latest row per key, missing times last, then the smaller row id (A3)."""
    t = F.col(time_us)
    return best_row(df, keys, [t.isNull(), -t, F.col(row_id)])


def first_row(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """First row per key in an explicit order (A5)."""
    return best_row(df, keys, [F.col(c) for c in order])


def click_priority_order(time_us: str = "t_us", row_id: str = "event_id") -> list[Column]:
    """Clicks first; among clicks the earliest, else the latest; missing time last; then the smaller id."""
    clicked, t = F.coalesce(F.col("is_click"), F.lit(0)) == 1, F.col(time_us)
    return [(~clicked).cast("int"), t.isNull(), F.when(clicked, t).otherwise(-t), F.col(row_id)]


def click_priority(
    df: DataFrame, keys: Sequence[str] = KEYS, time_us: str = "t_us", row_id: str = "event_id"
) -> DataFrame:
    """One row per key: the earliest click, or the latest impression of a key without clicks (A4)."""
    return best_row(df, keys, click_priority_order(time_us, row_id))


def unclicked_candidates(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Impressions whose key has no click at all."""
    clicked = df.where(F.col("is_click") == 1).select(*keys).distinct()
    return df.where(F.col("is_click") != 1).join(clicked, list(keys), "left_anti")


def positive_pairs(df: DataFrame, keys: Sequence[str] = ("user_id", "streamer_id", "live_id")) -> DataFrame:
    """A pair is positive when any of its impressions was clicked (A1)."""
    return df.groupBy(*keys).agg(F.max("is_click").cast("int").alias("is_positive"))


def distinct_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U6."""
    return df.select(*keys).distinct()


def most_frequent(df: DataFrame, key: str, value: str, time_us: str) -> DataFrame:
    """Most frequent value per key, ties by latest time, then by value (A2)."""
    counts = (
        df.dropna(subset=[key, value]).groupBy(key, value).agg(F.count("*").alias("_n"), F.max(time_us).alias("_t"))
    )
    t = F.col("_t")
    return best_row(counts, [key], [-F.col("_n"), t.isNull(), -t, F.col(value)]).select(key, value)
