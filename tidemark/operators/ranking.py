"""Top-K per group (T1, T3, T8): only K rows per task and group are shuffled; full ranking of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import GroupSizes, group_sizes, null_safe, range_count, renamed
from tidemark.session import materialise


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, name: str | None = "rank"
) -> DataFrame:
    """First ``k`` rows per group in a total order, with their 1-based place."""
    column = name or "_rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        F.col(column) <= k
    )
    return ranked if name else ranked.drop(column)


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    sizes: GroupSizes | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Adds the place, from 1, of every row of its group in a total order.

    Without a hot key this is one window.  With some, rows are dealt into ranges
    of about ``range_rows`` by key and order together, so that a group that is
    too large for one task fills several ranges; places are counted within each
    range, and the rows of the group in earlier ranges, one number for each
    range and key, are added.
    """
    sizes = sizes or group_sizes(df, keys)[0]
    if sizes.hot is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    df = materialise(df)
    parts = range_count(df.count(), range_rows)
    dealt = materialise(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *keys).orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inner))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", *renamed(keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    offsets = offsets.where("_before > 0").withColumnRenamed("_range", "_r__range")
    joined = placed.join(offsets, null_safe(placed, offsets, ["_range", *keys]), "left")
    place = F.col("_place") + F.coalesce("_before", F.lit(0))
    return joined.select(*[placed[c] for c in df.columns], place.cast("bigint").alias(name))
