"""Scalar building blocks (P1-P23): every function returns a Column or a projected DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, kind: str = "double", fill: float | int | None = None) -> Column:
    """Bad text to null, then an optional fill."""
    value = as_column(c).try_cast(kind)
    return value if fill is None else F.coalesce(value, F.lit(fill).cast(kind))


def to_id(c: str | Column, fill: int = -1) -> Column:
    return to_number(c, "bigint", fill)


def time_from_millis(c: str | Column) -> Column:
    """Epoch milliseconds to a timestamp."""
    return F.timestamp_millis(as_column(c).try_cast("bigint"))


def time_from_text(c: str | Column, fmt: str | None = None) -> Column:
    text = as_column(c).cast("string")
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def date_from_int(c: str | Column) -> Column:
    """``yyyymmdd`` integer to a date, invalid to null."""
    return time_from_text(c, "yyyyMMdd").cast("date")


def micros(c: str | Column) -> Column:
    """Event time as integer microseconds; accepts timestamps with or without zone."""
    return F.unix_micros(as_column(c).cast("timestamp"))


def rename_prefixed(df: DataFrame, columns: Iterable[str], prefix: str) -> DataFrame:
    """Prefix a set of columns, e.g. profile columns that exist on both sides."""
    return df.withColumnsRenamed({c: prefix + c for c in columns if c in df.columns})


def calendar_parts(c: str | Column, prefix: str) -> list[Column]:
    """Year, month, day, hour and weekend flag, Monday = 0."""
    t = as_column(c)
    return [
        F.year(t).alias(f"{prefix}_year"),
        F.month(t).alias(f"{prefix}_month"),
        F.dayofmonth(t).alias(f"{prefix}_day"),
        F.hour(t).alias(f"{prefix}_hour"),
        F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)).alias(f"{prefix}_is_weekend"),
    ]


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Calendar date from its parts, invalid combinations to null (P5)."""
    parts = [to_number(p, "int") for p in (year, month, day)]
    zero = F.lit(0)
    return F.try_make_timestamp(*parts, zero, zero, zero).cast("date")


def select_spec(df: DataFrame, names: Sequence[str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Requested columns in order, renamed through ``aliases``, absent and repeated ones skipped."""
    resolved = dict.fromkeys((aliases or {}).get(n, n) for n in names)
    return df.select(*[c for c in resolved if c in df.columns])


def missing_spec(df: DataFrame, names: Sequence[str], aliases: Mapping[str, str] | None = None) -> list[str]:
    """Requested columns the table does not have."""
    resolved = dict.fromkeys((aliases or {}).get(n, n) for n in names)
    return [c for c in resolved if c not in df.columns]


def clip(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound a value; null stays null."""
    value = as_column(c)
    out = value
    if high is not None:
        out = F.when(value > high, F.lit(high) if not isinstance(high, Column) else high).otherwise(out)
    if low is not None:
        out = F.when(value < low, F.lit(low) if not isinstance(low, Column) else low).otherwise(out)
    return out


def start_bucket(elapsed_ms: str | Column) -> Column:
    """Minutes since start in (-inf, 5], (5, 20], (20, inf) as 0, 1, 2; null as -1."""
    minutes = as_column(elapsed_ms) / F.lit(60000.0)
    return F.when(minutes.isNull(), -1).when(minutes <= 5, 0).when(minutes <= 20, 1).otherwise(2)


def elapsed(later_us: str | Column, earlier_us: str | Column, unit: str) -> Column:
    """Time between two microsecond columns in days, ms or s."""
    per_unit = {"day": 8.64e10, "ms": 1e3, "s": 1e6}[unit]
    return (as_column(later_us) - as_column(earlier_us)) / F.lit(per_unit)


def log_contrast(short: Column, long: Column, offset: float) -> Column:
    """Short against long window on a log scale (P10)."""
    return F.log(short + F.lit(offset)) - F.log(long + F.lit(offset))


def missing_flag(c: str | Column) -> Column:
    return as_column(c).isNull().cast("int")


def fill(c: str | Column, sentinel: float | int) -> Column:
    """Cold-start sentinel for a missing value."""
    return F.coalesce(as_column(c), F.lit(sentinel))


def multitask_labels(df: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Click, like, long-watch and log-watch targets."""
    watch = to_number("watch_live_time", "double", 0.0)
    watch = F.when(watch < 0, 0.0).otherwise(watch)
    if "watch_greater_30s" in df.columns:
        long_watch = to_number("watch_greater_30s", "double", 0.0).cast("int")
    else:
        long_watch = (watch >= threshold).cast("int")
    columns = {"watch_live_time": watch, "watch_greater_30s": long_watch, "watch_live_time_log": F.log1p(watch)}
    for flag in ("is_click", "is_like"):
        if flag in df.columns:
            columns[flag] = to_number(flag, "double", 0.0).cast("int")
    return df.withColumns(columns)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b`` with an empty denominator giving ``empty``."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def smoothed_rate(a: Column, b: Column) -> Column:
    return (a + F.lit(1.0)) / (b + F.lit(1.0))


def date_split(c: str | Column, train: tuple[str, str], val: tuple[str, str], test_from: str) -> Column:
    """Split name from the event date, null outside every window."""
    day = as_column(c).cast("date")
    as_date = lambda s: F.lit(s).cast("date")
    return (
        F.when(day.between(as_date(train[0]), as_date(train[1])), "train")
        .when(day.between(as_date(val[0]), as_date(val[1])), "val")
        .when(day >= as_date(test_from), "test")
    )


def item_key(live: str | Column = "live_id", streamer: str | Column = "streamer_id") -> Column:
    """Printable pair key; joins use the two columns themselves."""
    return F.concat_ws("_", to_id(live).cast("string"), to_id(streamer).cast("string"))


def allowed_or_unknown(c: str | Column, allowed: Sequence[int]) -> Column:
    """Null or a member of ``allowed``."""
    value = to_number(c, "double")
    return value.isNull() | value.isin(*[float(a) for a in allowed])


def recent(day: str | Column, reference: str, max_age_days: int) -> Column:
    """Within ``max_age_days`` up to and including the reference date."""
    ref = F.lit(reference).cast("date")
    return as_column(day).between(F.date_sub(ref, max_age_days), ref)


def mean_score(*scores: str | Column) -> Column:
    columns = [as_column(s) for s in scores]
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))


def weighted_relevance(weights: Mapping[str, float]) -> Column:
    """Weighted sum of task scores, missing scores as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * to_number(name, "double", 0.0)
    return total


def unscale_watch(c: str | Column, mean: float, std: float, low: float = -5.0, high: float = 12.0) -> Column:
    """Standardised log-watch prediction back to a time."""
    return F.expm1(clip(as_column(c) * F.lit(std) + F.lit(mean), low, high))


def hash_fraction(*columns: str | Column, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the row's identity: the same on every run, cluster and engine."""
    text = F.concat_ws("|", *[as_column(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def repeatable_sample(df: DataFrame, fraction: float, *id_cols: str, seed: int = 42) -> DataFrame:
    """Random sample that does not depend on partitioning (P20)."""
    return df if fraction >= 1.0 else df.where(hash_fraction(*id_cols, seed=seed) < fraction)


def log_shifted(c: str | Column, minimum: float, method: str = "log1p") -> Column:
    """log1p or log after lifting a negative minimum to 0."""
    value = as_column(c).cast("double") + F.lit(max(-minimum, 0.0))
    if method == "log1p":
        return F.log1p(value)
    if method == "log":
        return F.log(F.nullif(value, F.lit(0.0)))
    raise ValueError("method must be 'log1p' or 'log'")


def logit(c: str | Column, eps: float = 1e-6) -> Column:
    """log(p / (1 - p)) of a clipped rate."""
    p = clip(as_column(c).cast("double"), eps, 1 - eps)
    return F.log(p / (F.lit(1.0) - p))


def fill_block(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Model-ready numbers: bad or missing to ``value``."""
    return df.withColumns({c: to_number(c, "double", value) for c in columns if c in df.columns})


def drop_incomplete(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """Rows with a null or unreadable key or event time leave."""
    typed = df.withColumns({k: to_number(k, "bigint") for k in keys})
    return typed.dropna(subset=[*keys, time_col])


LN2 = math.log(2.0)
