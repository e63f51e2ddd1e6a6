"""Past-only aggregates over an event log (the engine behind W1-W24, O12, O13)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY_US
from tidemark.operators.skew import (
    SLIDING_ROWS,
    GroupSizes,
    group_sizes,
    null_safe,
    renamed,
    running_past,
)

TIME = "t_us"
ROW = "event_id"
AMOUNT_SCALE = 1_000_000
_FRACTIONS = ("double", "float", "decimal")


@dataclass(frozen=True)
class Past:
    """One past aggregate: ``sum`` or ``max`` of a column over ``[t - window, t)``, or over all earlier rows.

    Sums of fractions (``amount``) are taken in whole micro-units: parts below
    1e-6 are rounded away, and a sum beyond 9.2e12 fails with an overflow error
    of Spark's ANSI arithmetic instead of wrapping around.
    """

    name: str
    value: str
    window_us: int | None = None
    agg: str = "sum"
    amount: bool = False

    def __post_init__(self) -> None:
        if self.agg == "max" and self.window_us is not None:
            raise ValueError(f"{self.name}: a maximum is taken over all earlier rows, not over a window")


def _scaled(value: Column) -> Column:
    """Amounts as integer micro-units: sums do not depend on the order of rows and cannot drift."""
    return F.round(value * F.lit(float(AMOUNT_SCALE))).cast("bigint")


def _value(spec: Past) -> Column:
    return _scaled(F.col(spec.value)) if spec.amount else F.col(spec.value)


def past_aggregates(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[Past],
    sizes: GroupSizes | None = None,
    strategy: str = "auto",
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds one column per spec; sums over an empty past are 0, maxima null.

    A row without a time sees nothing in a window and is in nobody's; sums of
    fractions are amounts, held in micro-units.  ``strategy``: "range" uses
    sliding range frames, whose cost grows with the rows inside a frame;
    "expiry" is linear in the rows and splits hot keys; "auto" takes the first
    while the largest key is small.  Both give the same values.
    """
    specs = [
        replace(s, amount=s.agg == "sum" and (s.amount or df.schema[s.value].dataType.typeName() in _FRACTIONS))
        for s in specs
    ]
    if sizes is None:
        sizes = group_sizes(df, keys)[0]
    whole = [s for s in specs if s.window_us is None]
    rolling = [s for s in specs if s.window_us is not None]
    linear = strategy == "expiry" or (strategy == "auto" and sizes.largest > SLIDING_ROWS)
    source = df if source is None else source
    out = df
    if whole:
        out = running_past(
            out,
            keys,
            [TIME, ROW],
            {s.name: (s.agg, _value(s)) for s in whole},
            sizes=sizes,
            source=source,
        )
    if rolling and linear:
        out = _rolling_by_expiry(out, source, keys, rolling, sizes)
    elif rolling:
        windows = {
            w: Window.partitionBy(*keys).orderBy(TIME).rangeBetween(-w, -1) for w in {s.window_us for s in rolling}
        }
        timed = F.col(TIME).isNotNull()
        out = out.select(
            "*", *[F.when(timed, F.sum(_value(s)).over(windows[s.window_us])).alias(s.name) for s in rolling]
        )
    final = {}
    for s in specs:
        if s.agg == "sum":
            total = F.coalesce(F.col(s.name), F.lit(0))
            final[s.name] = total / F.lit(float(AMOUNT_SCALE)) if s.amount else total
    return out.withColumns(final)


def _events_of(sizes: GroupSizes, widths: int) -> GroupSizes:
    """Sizes of the arrivals and expiries: each cell of a hot key is there once more for every window."""
    if sizes.hot is None:
        return sizes
    return replace(sizes, hot=sizes.hot.withColumn("_n", F.col("_n") * (1 + widths)))


def _rolling_by_expiry(
    df: DataFrame, source: DataFrame, keys: Sequence[str], specs: Sequence[Past], sizes: GroupSizes
) -> DataFrame:
    """Rolling sums as running sums over arrivals and expiries.

    Every (key, time) cell enters at ``t`` and leaves each window ``w`` at
    ``t + w``; a running sum over strictly earlier times is then the sum over
    ``[t - w, t)``.  Cells are aggregated before the shuffle, which also folds
    bursts of equal time stamps.
    """
    values = {}
    for s in specs:
        values.setdefault(s.value, f"_v{len(values)}")
    amounts = {s.value for s in specs if s.amount}
    widths = sorted({s.window_us for s in specs})
    cells = source.groupBy(*keys, TIME).agg(
        *[F.sum(_scaled(F.col(v)) if v in amounts else F.col(v).cast("bigint")).alias(a) for v, a in values.items()]
    )
    steps = F.array(F.lit(0).cast("bigint"), *[F.lit(w).cast("bigint") for w in widths])
    events = (
        cells.withColumn("_step", F.explode(steps)).withColumn("_at", F.col(TIME) + F.col("_step")).drop(TIME)
    )
    measures = {}
    for s in specs:
        v = F.col(values[s.value])
        signed = F.when(F.col("_step") == 0, v).when(F.col("_step") == s.window_us, -v).otherwise(F.lit(0))
        measures[s.name] = ("sum", signed)
    scanned = running_past(events, keys, ["_at"], measures, frame="range", sizes=_events_of(sizes, len(widths)))
    answers = scanned.where(F.col("_step") == 0).select(
        *renamed(keys),
        F.col("_at").alias("_t"),
        *[s.name for s in specs],
    )
    joined = df.join(answers, null_safe(df, answers, keys) & (df[TIME] == answers["_t"]), "left")
    return joined.select(*[df[c] for c in df.columns], *[answers[s.name] for s in specs])


def past_last_time(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    sizes: GroupSizes,
    source: DataFrame | None = None,
) -> DataFrame:
    """Latest earlier time at which a condition held (``lag``, last-non-null): a running maximum."""
    measures = {name: ("max", F.when(cond, F.col(TIME))) for name, cond in columns.items()}
    return running_past(df, keys, [TIME, ROW], measures, sizes=sizes, source=source)


def _placed(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    counted = running_past(df, keys, [TIME, ROW], {"_n": ("sum", F.lit(1).cast("bigint"))}, **options)
    return counted.withColumn("_pos", F.coalesce(F.col("_n"), F.lit(0)))


def skips_since(
    df: DataFrame,
    keys: Sequence[str],
    flag: str,
    name: str,
    sizes: GroupSizes,
    source: DataFrame | None = None,
) -> DataFrame:
    """Rows since the latest flagged row, which itself counts 0."""
    source = df if source is None else source
    options = {"sizes": sizes}
    hit = {"_hit": ("max", F.when(F.col(flag) == 1, F.col("_pos")))}
    placed = _placed(df, keys, source=source, **options)
    twin = _placed(source, keys, **options) if sizes.hot is not None else None
    marked = running_past(placed, keys, [TIME, ROW], hit, include_current=True, source=twin, **options)
    return marked.withColumn(name, F.col("_pos") - F.coalesce(F.col("_hit"), F.lit(0))).drop("_n", "_pos", "_hit")


def rolling_distinct(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    window_us: int,
    name: str,
    sizes: GroupSizes,
    source: DataFrame | None = None,
) -> DataFrame:
    """Distinct values in ``[t - window, t)`` in linear time.

    A value is visible from its first event until ``window`` after the last
    one of an unbroken run.  Runs are found on one row per (key, value, day),
    then counted by a running sum of run starts and ends.
    """
    step = min(DAY_US, window_us)
    source = df if source is None else source
    days = (
        source.where(F.col(value).isNotNull())
        .withColumn("_day", F.floor(F.col(TIME) / F.lit(step)))
        .groupBy(*keys, value, "_day")
        .agg(F.min(TIME).alias("_first"), F.max(TIME).alias("_last"))
    )
    # One row per day of the log: bounded by the span of the log, not by the traffic.
    by_value = Window.partitionBy(*keys, value).orderBy("_day")
    runs = days.select(
        *keys,
        "_first",
        "_last",
        (F.col("_first") - F.lag("_last").over(by_value)).alias("_gap_before"),
        (F.lead("_first").over(by_value) - F.col("_last")).alias("_gap_after"),
    )
    starts = runs.where(F.col("_gap_before").isNull() | (F.col("_gap_before") > window_us)).select(
        *keys, F.col("_first").alias("_at"), F.lit(1).alias("_delta")
    )
    ends = runs.where(F.col("_gap_after").isNull() | (F.col("_gap_after") > window_us)).select(
        *keys, (F.col("_last") + F.lit(window_us)).alias("_at"), F.lit(-1).alias("_delta")
    )
    moves = starts.unionByName(ends).groupBy(*keys, "_at").agg(F.sum("_delta").alias("_delta"))
    asks = source.select(*keys, F.col(TIME).alias("_at")).distinct()
    timeline = moves.withColumn("_ask", F.lit(0)).unionByName(
        asks.withColumn("_delta", F.lit(0).cast("bigint")).withColumn("_ask", F.lit(1))
    )
    scanned = running_past(
        timeline, keys, ["_at"], {"_n": ("sum", F.col("_delta"))}, frame="range", sizes=sizes
    )
    answers = scanned.where(F.col("_ask") == 1).select(
        *renamed(keys), F.col("_at").alias("_t"), F.col("_n").alias(name)
    )
    joined = df.join(answers, null_safe(df, answers, keys) & (df[TIME] == answers["_t"]), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce(answers[name], F.lit(0)).cast("bigint").alias(name))
