"""Attribution of follow-up events to the latest earlier click."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar_parts
from tidemark.operators.skew import GroupSizes, group_sizes, running_past

KEYS = ["user_id", "live_id", "streamer_id"]
KINDS = ("like", "comment", "gift")


def timeline(clicks: DataFrame, followups: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Clicks and follow-ups on one time axis (U2); a click precedes a follow-up of the same instant."""
    left = clicks.select(*keys, "t_us", "event_id", F.lit("click").alias("kind"), F.lit(0).alias("after"))
    right = followups.select(*keys, "t_us", "event_id", "kind", F.lit(1).alias("after"), "amount")
    return left.unionByName(right, allowMissingColumns=True)


def attribute_followups(
    clicks: DataFrame,
    followups: DataFrame,
    keys: Sequence[str] = KEYS,
    kinds: Sequence[str] = KINDS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Latest follow-up time per kind, and its amount, on each click.

    A backward as-of match with equality allowed.  All kinds share one running
    maximum over the union of the streams.  A click's columns travel on its
    row, and clicks gather their follow-ups where the key already lies, so each
    input is read once and nothing is joined back.  Of clicks that agree in
    key, time and id only one gets a follow-up: the one whose other columns
    have the greatest hash, which is the same one however often and in whatever
    order the rows are read.  Clicks without a follow-up keep nulls, follow-ups
    before any click leave.  ``followups`` has the
    columns ``kind`` and ``amount``.
    """
    keys = list(keys)
    clean = clicks.dropna(subset=[*keys, "t_us"])
    carried = [c for c in clean.columns if c not in (*keys, "t_us", "event_id")]
    left = clean.select(
        *keys, "t_us", "event_id", F.lit(0).alias("after"),
        F.xxhash64(F.lit(0), *carried).alias("_copy"), F.struct(F.lit(1).alias("_own"), *carried).alias("_row"),
    )
    right = followups.dropna(subset=[*keys, "t_us"]).select(*keys, "t_us", "event_id", F.lit(1).alias("after"), "kind", "amount")
    events = left.unionByName(right, allowMissingColumns=True)
    if sizes is None:
        sizes = group_sizes(clean.select(*keys).unionByName(right.select(*keys)), keys)[0]
    click = F.when(F.col("after") == 0, F.struct("t_us", "event_id", "_copy"))
    order = ["t_us", "after", "event_id", "_copy"]  # a click's own place is the last up to itself
    matched = running_past(events, keys, order, {"_click": ("max", click)}, include_current=True, sizes=sizes)
    after = F.col("after") == 1
    gift = F.struct("t_us", "event_id", "amount")
    per_click = (
        matched.where(F.col("_click").isNotNull())
        .groupBy(*keys, "_click")
        .agg(
            F.first("_row", ignorenulls=True).alias("_row"),
            F.count("_row").alias("_equal"),
            *[F.max(F.when(after & (F.col("kind") == k), F.col("t_us"))).alias(f"latest_{k}_us") for k in kinds],
            F.max(F.when(after & (F.col("kind") == "gift") & F.col("amount").isNotNull(), gift)).alias("_gift"),
        )
    )
    # Rows that are equal in all columns are one group; the first of them has the follow-ups.
    per_click = per_click.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "_equal")))
    latest = {k: F.when(F.col("_nth") == 1, F.col(f"latest_{k}_us")) for k in kinds}
    origin = {"t_us": "_click.t_us", "event_id": "_click.event_id", **{c: f"_row.{c}" for c in carried}}
    return per_click.select(
        *[F.col(origin.get(c, c)).alias(c) for c in clean.columns],
        *[c.alias(f"latest_{k}_us") for k, c in latest.items()],
        *[c.isNotNull().cast("int").alias(f"is_{k}") for k, c in latest.items()],
        F.when(F.col("_nth") == 1, F.col("_gift.amount")).alias("gift_price"),
    )


def build_interactions(clicks: DataFrame, negatives: DataFrame, followups: DataFrame, **options) -> DataFrame:
    """Labelled impressions: attributed clicks and negatives with zero labels, with calendar parts."""
    labelled = attribute_followups(clicks, followups, **options).withColumn("is_click", F.lit(1))
    zero = {"is_click": F.lit(0), "watch_live_time": F.lit(0.0), "gift_price": F.lit(0.0)}
    zero.update({f"is_{k}": F.lit(0) for k in KINDS})
    union = labelled.unionByName(negatives.withColumns(zero), allowMissingColumns=True)
    return union.withColumn("gift_price", F.coalesce("gift_price", F.lit(0.0))).select(
        "*", *calendar_parts("imp_timestamp", "imp")
    )
