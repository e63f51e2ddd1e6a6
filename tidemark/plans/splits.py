"""De-duplicated, dated splits in one scan and one shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tidemark.functions.columns import date_split, multitask_labels, select_spec
from tidemark.operators.dedup import click_priority

DATES = {"train": ("2025-05-04", "2025-05-18"), "val": ("2025-05-19", "2025-05-22"), "test_from": "2025-05-23"}


def with_split(df: DataFrame, time: str = "imp_timestamp", dates: Mapping = DATES) -> DataFrame:
    return df.withColumn("split", date_split(time, dates["train"], dates["val"], dates["test_from"]))


def retrieval_splits(df: DataFrame, dates: Mapping = DATES) -> DataFrame:
    """One row per (live, streamer, user) by click priority, with its split."""
    return with_split(click_priority(df), dates=dates)


def ranking_splits(df: DataFrame, columns: Sequence[str], dates: Mapping = DATES, dedup: bool = False) -> DataFrame:
    """All impressions with multitask labels and the requested columns, with their split."""
    rows = with_split(multitask_labels(click_priority(df) if dedup else df), dates=dates)
    return select_spec(rows, [*columns, "split"])
