"""Data profiles and accounting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scalers import exact_quantiles


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts."""
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def unique_per_user(df: DataFrame, column: str, user: str = "user_id") -> DataFrame:
    return df.select(user, column).distinct().groupBy(user).agg(F.count(column).alias(f"n_{column}"))


def split_summary(df: DataFrame, labels: Sequence[str], watch: str = "watch_live_time", time: str = "t_us") -> DataFrame:
    """Rows, time bounds, label rates and watch statistics per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("min_t"),
        F.max(time).alias("max_t"),
        *[F.avg(F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_rate") for c in labels],
        F.avg(F.coalesce(F.col(watch), F.lit(0.0))).alias(f"{watch}_mean"),
        F.stddev_pop(F.coalesce(F.col(watch), F.lit(0.0))).alias(f"{watch}_std"),
    )


def date_counts(df: DataFrame, time: str, last: int | None = None) -> DataFrame:
    """Rows per date, missing times left out."""
    counts = (
        df.where(F.col(time).isNotNull())
        .groupBy(F.col(time).cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts if last is None else counts.orderBy(F.col("day").desc()).limit(last)


def user_balance(df: DataFrame, label: str, user: str = "user_id") -> DataFrame:
    """Positives, negatives and rows per user: mean and population deviation (A10)."""
    y = F.col(label)
    per_user = df.groupBy(user).agg(
        F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"), F.count(y).alias("total")
    )
    return per_user.agg(
        F.count(F.lit(1)).alias("users"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("positives", "negatives", "total")],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in ("positives", "negatives", "total")],
    )


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """Class counts and negatives per positive."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 1).alias("pos_count"), F.count_if(y == 0).alias("neg_count"))
    return counts.withColumn("pos_weight", F.col("neg_count") / F.greatest(F.col("pos_count"), F.lit(1)))


def row_accounting(df: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """Initial, kept, removed and per-split rows; the parts add up to the start."""
    raw = df.agg(F.count(F.lit(1)).alias("initial_rows"))
    kept = deduplicated.agg(
        F.count(F.lit(1)).alias("dedup_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        F.count_if(F.col("split").isNull()).alias("outside_rows"),
    )
    # Two one-row tables.
    both = raw.withColumn("_one", F.lit(1)).join(kept.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("removed_rows", F.col("initial_rows") - F.col("dedup_rows"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and the rows they hold."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return repeated.agg(
        F.count(F.lit(1)).alias("duplicated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_duplicated_keys")
    )


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent per column, all columns in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])
    return row.select(F.explode(pairs).alias("s"), "_rows").select(
        "s.column",
        "s.n_null",
        F.coalesce(F.try_divide(F.col("s.n_null") * 100.0, F.col("_rows")), F.lit(0.0)).alias("pct_null"),
    )


DESCRIBE = [0.01, 0.05, 0.5, 0.95, 0.99]


def describe(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """count, mean, std, min, exact percentiles, max, unique values per column."""
    quantiles = exact_quantiles(df, {c: (F.col(c), DESCRIBE) for c in columns}, **options)
    stats = []
    for c in columns:
        stats += [
            F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
            F.count_distinct(c).alias(f"{c}__unique"),
        ]
    row = df.agg(*stats)
    names = ["count", "mean", "std", "min", "max", "unique"]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                *[F.col(f"{c}__{n}").alias(n) for n in names],
                *[F.lit(v).cast("double").alias(f"p{int(q * 100):02d}") for q, v in zip(DESCRIBE, quantiles[c])],
            )
            for c in columns
        ]
    )
    return row.select(F.explode(entries).alias("s")).select("s.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def numeric_profile(df: DataFrame, column: str, iqr_k: float = 1.5, **options) -> DataFrame:
    """Adjusted skewness, IQR bounds and outlier share."""
    x = F.col(column).cast("double")
    q1, q3 = exact_quantiles(df, {column: (x, [0.25, 0.75])}, **options)[column]
    empty = q1 is None  # no value at all: no bounds, no outliers
    low, high = (None, None) if empty else (q1 - iqr_k * (q3 - q1), q3 + iqr_k * (q3 - q1))
    low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
    row = df.agg(F.count(x).alias("n"), F.skewness(x).alias("g"), F.count_if((x < low) | (x > high)).alias("out"))
    n, flat = F.col("n").cast("double"), q3 == q1
    outliers = F.lit(0).cast("bigint") if flat else F.col("out")
    return row.select(
        F.lit(column).alias("column"),
        F.col("n").alias("count"),
        F.try_divide(F.col("g") * F.sqrt(n * (n - 1)), n - 2).alias("skewness"),
        low.alias("lower_bound"),
        high.alias("upper_bound"),
        outliers.alias("outliers"),
        F.try_divide(outliers * 100.0, n).alias("outlier_pct"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram with the last bin closed (A17); empty bins are absent."""
    x = F.col(column).cast("double")
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    low, high = row["lo"], row["hi"]
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("rows")).where(F.lit(False))
    width = (high - low) / bins if high > low else 1.0
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break each named rule, in one pass."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("rows")) for n in checks])
    return row.select(F.explode(pairs).alias("s")).select("s.*")


def missing_features(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Expected columns that are absent."""
    return [c for c in expected if c not in df.columns]
