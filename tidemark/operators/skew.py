"""Running aggregates that survive a very popular key.

A window over ``partitionBy(key)`` puts a whole key into one task.  Here the
keys with too many rows for that are found first, by exact counts.  Without
one the plain window is used.  With some, their rows are cut along the time
axis into slices of about equal row counts: each slice is scanned on its own,
slice totals (one small row per key and slice) are accumulated, and each row
adds the total of the slices before it.  Which keys count as hot, and where
they are cut, only steers the plan: the result is the same for any choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Rows of one key that a single task may hold in a window.
HOT_ROWS = 2_000_000
#: Up to this largest key, sliding range frames are cheaper than the linear plan; both give the same sums.
SLIDING_ROWS = 4_000
#: Hashed bins that keys are counted in before any key is counted on its own.
BINS = 1 << 16
COLD_SLICE = -1
#: Slices of the largest key, and ranges of a globally ordered table, before they grow to what a task may hold.
SLICES, RANGES = 64, 256
#: Rows of one range of a globally ordered table.
RANGE_ROWS = 1_000_000
MAX_EDGES = 256


@dataclass(frozen=True)
class GroupSizes:
    """The hot keys as a stored table with their counts ``_n``, if there are any, and an upper bound of the largest group.

    The bound is a hashed bin's count, so it exceeds every group but may exceed
    the largest one by far where a bin holds many keys: a table of more than
    ``BINS`` times SLIDING_ROWS rows always takes the linear plans.
    """

    largest: int = 0
    hot: DataFrame | None = None
    slice_rows: int = HOT_ROWS


def group_sizes(df: DataFrame, *key_sets: Sequence[str], hot_rows: int | None = None) -> list[GroupSizes]:
    """Largest group and hot keys of several key sets.

    One narrow pass counts hashed bins of keys, combined on the map side; a
    bin's count bounds each of its keys.  Only keys of bins with at least
    ``hot_rows`` rows are then counted one by one, so every hot key is found.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    bins = [F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BINS)).cast("int") for keys in key_sets]
    marks = F.array(*[F.struct(F.lit(i).alias("set"), b.alias("bin")) for i, b in enumerate(bins)])
    counted = df.select(F.explode(marks).alias("m")).groupBy("m.set", "m.bin").agg(F.count(F.lit(1)).alias("n"))
    heavy = F.collect_list(F.when(F.col("n") >= hot_rows, F.col("bin"))).alias("heavy")  # BINS numbers at most
    found = {r["set"]: r for r in counted.groupBy("set").agg(F.max("n").alias("n"), heavy).collect()}
    sizes = []
    for i, keys in enumerate(key_sets):
        row = found.get(i)
        if row is None or not row["heavy"]:
            sizes.append(GroupSizes(row["n"] if row else 0, None, hot_rows))
            continue
        narrowed = df.select(*keys).where(bins[i].isin(row["heavy"]))
        hot = materialise(narrowed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows))
        sizes.append(GroupSizes(row["n"], None if hot.isEmpty() else hot, hot_rows))
    return sizes


def grown(sizes: GroupSizes) -> GroupSizes:
    """The sizes with slices that grow with the largest key, up to HOT_ROWS: only beyond that their number does."""
    if sizes.hot is None:
        return sizes
    largest = sizes.hot.agg(F.max("_n")).first()[0]
    return replace(sizes, slice_rows=max(sizes.slice_rows, min(math.ceil(2 * largest / SLICES), HOT_ROWS)))


def range_count(rows: int, range_rows: int | None = None) -> int:
    """Ranges of a table of so many rows: of ``range_rows`` while they are few, then growing up to RANGE_ROWS."""
    return max(math.ceil(rows / max(range_rows or RANGE_ROWS, min(math.ceil(rows / RANGES), RANGE_ROWS))), 1)


def slice_cuts(df: DataFrame, keys: Sequence[str], axis: str, sizes: GroupSizes) -> DataFrame | None:
    """(``_r_`` keys, _cuts): per hot key the places on ``axis`` that cut its rows into slices of about ``slice_rows``."""
    if sizes.hot is None:
        return None
    largest = sizes.hot.agg(F.max("_n")).first()[0]
    parts = max(math.ceil(2 * largest / grown(sizes).slice_rows), 2)
    hot = sizes.hot.select(*renamed(keys))
    rows = df.select(*keys, axis)
    rows = rows.join(hot, null_safe(rows, hot, keys), "left_semi")
    places = [i / parts for i in range(1, parts)]
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(axis, places, 20 * parts)).alias("_cuts"))
    return materialise(cuts.select(*renamed(keys), F.coalesce("_cuts", F.array().cast("array<bigint>")).alias("_cuts")))


def with_slices(df: DataFrame, keys: Sequence[str], axis: str, cuts: DataFrame | None) -> DataFrame:
    """Adds ``_slice``: the number of cuts at or below the row for a hot key, one slice for every other key."""
    if cuts is None:
        return df.withColumn("_slice", F.lit(COLD_SLICE))
    joined = df.join(cuts, null_safe(df, cuts, keys), "left")
    place = F.size(F.filter("_cuts", lambda c: c <= F.col(axis)))
    return joined.select(
        *[df[c] for c in df.columns],
        F.when(F.col("_cuts").isNull(), F.lit(COLD_SLICE)).otherwise(place).alias("_slice"),
    )


def renamed(keys: Sequence[str], prefix: str = "_r_") -> list[Column]:
    """The key columns under other names, for the right side of a null-safe join."""
    return [F.col(k).alias(prefix + k) for k in keys]


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "_r_") -> Column:
    """Join condition that lets null keys meet; the right side holds ``renamed`` keys."""
    condition = left[keys[0]].eqNullSafe(right[prefix + keys[0]])
    for k in keys[1:]:
        condition = condition & left[k].eqNullSafe(right[prefix + k])
    return condition


_AGGREGATES = {"sum": F.sum, "max": F.max}


def running_past(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    *,
    frame: str = "rows",
    include_current: bool = False,
    sizes: GroupSizes | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds past-only running ``sum`` / ``max`` columns per key.

    ``frame="rows"`` takes every earlier row in ``order``; ``frame="range"``
    takes rows with a strictly smaller first ordering value.  ``source`` is a
    table with the same rows and the measured columns that is cheap to read
    twice; cuts and slice totals come from it.
    """
    last = 0 if include_current else -1

    def framed(by: Sequence[str]):
        if frame == "range":
            return Window.partitionBy(*by).orderBy(order[0]).rangeBetween(Window.unboundedPreceding, last)
        return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)

    if sizes is None or sizes.hot is None:
        window = framed(keys)
        return df.select(
            "*", *[_AGGREGATES[agg](value).over(window).alias(name) for name, (agg, value) in measures.items()]
        )

    source = df if source is None else source
    cuts = slice_cuts(source, keys, order[0], sizes)
    window = framed([*keys, "_slice"])
    local = with_slices(df, keys, order[0], cuts).select(
        "*", *[_AGGREGATES[agg](value).over(window).alias(f"_in_{name}") for name, (agg, value) in measures.items()]
    )
    totals = (
        with_slices(source, keys, order[0], cuts)
        .where(F.col("_slice") != COLD_SLICE)
        .groupBy(*keys, "_slice")
        .agg(*[_AGGREGATES[agg](value).alias(f"_t_{name}") for name, (agg, value) in measures.items()])
    )
    # One row per hot key and slice.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *renamed([*keys, "_slice"]),
        *[_AGGREGATES[agg](f"_t_{name}").over(before).alias(f"_off_{name}") for name, (agg, _) in measures.items()],
    )
    joined = local.join(offsets, null_safe(local, offsets, [*keys, "_slice"]), "left")
    combined = []
    for name, (agg, _) in measures.items():
        inside, outside = F.col(f"_in_{name}"), F.col(f"_off_{name}")
        if agg == "sum":
            value = F.when(inside.isNull(), outside).when(outside.isNull(), inside).otherwise(inside + outside)
        else:
            value = F.greatest(inside, outside)
        combined.append(value.alias(name))
    return joined.select(*[local[c] for c in df.columns], *combined)


def split_points(df: DataFrame, columns: Sequence[str], parts: int = MAX_EDGES) -> list:
    """Cut values that divide the distinct rows of ``df`` into about equal ranges.

    The rows with the smallest hashes are a uniform, repeatable sample of
    bounded size; it only places the cuts.
    """
    picked = (
        df.select(*columns).orderBy(F.xxhash64(*[F.col(c) for c in columns])).limit(16 * parts).collect()
    )
    if len(picked) < 16 * parts:
        return []
    rows = sorted(tuple(r) for r in picked if all(v is not None for v in r))
    step = max(len(rows) // parts, 1)
    return rows[step::step]


def global_running(
    df: DataFrame, columns: Sequence[str], measures: dict[str, Column], range_rows: int | None = None
) -> DataFrame:
    """Running sums in the order of unique ``columns`` over a whole table, without one global sort task.

    Adds, per measure, ``<name>_before`` (sum over smaller rows) as a column.
    The table is dealt into ranges of about ``range_rows`` rows and stored with
    its range numbers; ranges are scanned on their own and their totals, one
    row each, are accumulated.
    """
    df = materialise(df)
    parts = range_count(df.count(), range_rows)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if parts == 1:  # at most range_rows rows
        whole = Window.partitionBy(F.lit(0)).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
        local = df.select("*", *[F.sum(v).over(whole).alias(f"_in_{n}") for n, v in measures.items()])
        return local.select(*df.columns, *[zero(f"_in_{n}").alias(f"{n}_before") for n in measures])
    dealt = df.repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id())
    parted = materialise(dealt)
    inner = Window.partitionBy("_part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    local = parted.select("*", *[F.sum(v).over(inner).alias(f"_in_{n}") for n, v in measures.items()])
    totals = parted.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in measures.items()])
    # One row per range.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(totals.select("_part", *[F.sum(f"_t_{n}").over(before).alias(f"_off_{n}") for n in measures]))
    joined = local.join(offsets, "_part", "left")
    return joined.select(
        *df.columns, *[(zero(f"_in_{n}") + zero(f"_off_{n}")).alias(f"{n}_before") for n in measures]
    )


def dense_index(
    distinct_rows: DataFrame, columns: Sequence[str], name: str, start: int = 0, range_rows: int | None = None
) -> DataFrame:
    """Position of each distinct row in sorted order, counted across all ranges."""
    indexed = global_running(distinct_rows, columns, {"_n": F.lit(1).cast("bigint")}, range_rows)
    return indexed.withColumn(name, F.col("_n_before") + F.lit(start)).drop("_n_before")
