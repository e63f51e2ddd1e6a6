"""Exact past medians per key, solved on ranks for many rows at once.

A key that is not hot is one group.  A hot key is cut along time, at its slice
cuts and at those moved by each window's width.  The windows of the rows of one
stretch then differ only in

* the stretch's own rows, which enter, and
* the rows that leave: those between the first and the last left end, which is
  a part of one earlier slice (the *halo*; halos do not overlap),

and share everything between, the *middle*.  With ``v`` entering and leaving
values the median moves over about ``v / 2`` values of the middle, and no others
are needed.  They are found by counting: values are ranked once, ranks are cut
into bins, bins are counted for each cell of time, and differences of running
counts give the middle of any stretch.  So each row is in one stretch and in one
halo for each window, and the middles of a window add at most about as many
values again, whatever the number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rolling import ROW, TIME
from tidemark.operators.skew import COLD_SLICE, GroupSizes, global_running, grown, null_safe, slice_cuts
from tidemark.session import materialise

MIDDLE, HALO, OWN = 0, 1, 2
#: Bins of value ranks for each slice of a hot key.
BINS = 16
#: Rows that are solved together, and their bytes; a larger group is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 500_000, 64 << 20


def ranged_smallest(values: np.ndarray, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The ``nth`` smallest (from 0) of ``values[left:right]`` for every query at once.

    The ranks are split bit by bit from the top, zeros before ones in their
    order; a query follows its side by counting the zeros before its ends.  The
    work is (values + queries) times the bits of a rank.
    """
    levels, ranks = np.unique(values, return_inverse=True)
    left, right, nth, found = left.copy(), right.copy(), nth.copy(), np.zeros(len(nth), np.int64)
    for bit in range(max(int(len(levels) - 1).bit_length(), 1) - 1, -1, -1):
        ones = (ranks >> bit) & 1
        zeros_before = np.append(0, np.cumsum(1 - ones))
        low, high = zeros_before[left], zeros_before[right]
        up = nth >= high - low
        nth -= np.where(up, high - low, 0)
        found |= up.astype(np.int64) << bit
        left = np.where(up, zeros_before[-1] + left - low, low)
        right = np.where(up, zeros_before[-1] + right - high, high)
        ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])
    return levels[found]


def _medians(values: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mean of the ``low``-th and ``high``-th smallest of each range; NaN where the range is empty."""
    out = np.full(len(left), np.nan)
    some = np.flatnonzero(right > left)
    if len(some):
        both = [np.concatenate([x[some], x[some]]) for x in (left, right)]
        picked = ranged_smallest(values, *both, np.concatenate([low[some], high[some]]))
        out[some] = (picked[: len(some)] + picked[len(some) :]) / 2.0
    return out


def _numbers(column: pa.ChunkedArray, empty: float = 0) -> np.ndarray:
    return pc.fill_null(column, empty).to_numpy()


class _Block:
    """Whole groups in order: middle, halo and own rows of each."""

    def __init__(self, table: pa.Table, value: str):
        self.role = _numbers(table.column("_role"))
        self.output = _numbers(table.column("_output"))
        self.group = np.cumsum(_numbers(table.column("_rn")) == 1) - 1
        self.groups = int(self.group[-1]) + 1
        self.own = self.role == OWN
        self.timed = pc.is_valid(table.column(TIME)).to_numpy()
        self.time = _numbers(table.column(TIME))
        self.value = _numbers(table.column(value), np.nan)
        self.filled = ~np.isnan(self.value)
        self.weight, self.below, self.total = (_numbers(table.column(c)) for c in ("_weight", "_below", "_total"))

    def _sizes(self, groups: np.ndarray) -> np.ndarray:
        return np.bincount(groups, minlength=self.groups)

    def _middle(self, output: int, moving: np.ndarray) -> tuple[np.ndarray, ...]:
        """(values, groups) of the middle that a median can reach, and each group's values below them and in all."""
        at = (self.role == MIDDLE) & (self.output == output)
        total, below = np.zeros(self.groups, np.int64), np.zeros(self.groups, np.int64)
        total[self.group[at]], below[self.group[at]] = self.total[at], self.below[at]
        first, final = (total - moving) // 2 - 1, -((-total - moving) // 2)
        weight, g = self.weight[at], self.group[at]
        run = np.cumsum(weight) - weight
        start = run - run[np.searchsorted(g, g)] + below[g]
        reach = np.clip(np.minimum(start + weight, final[g] + 1) - np.maximum(start, first[g]), 0, None)
        return np.repeat(self.value[at], reach), np.repeat(g, reach), np.maximum(below, np.maximum(first, 0)), total

    def medians(self, output: int, width: int | None) -> np.ndarray:
        """Medians of the own rows over all earlier rows (``None``) or over ``[t - width, t)``.

        Each group is laid out as halo, middle, own values; a row's window is one run of that.  A row without a
        time sees nothing in a window and is in none.
        """
        inside = self.filled if width is None else self.filled & self.timed
        halo, own = inside & (self.role == HALO) & (self.output == output), inside & self.own
        n_halo, n_own = self._sizes(self.group[halo]), self._sizes(self.group[own])
        middle, of, below, total = self._middle(output, n_halo + n_own)
        n_middle = self._sizes(of)
        group = np.concatenate([self.group[halo], of, self.group[own]])
        order = np.argsort(group, kind="stable")
        values = np.concatenate([self.value[halo], middle, self.value[own]])[order]
        size = n_halo + n_middle + n_own
        start = np.cumsum(size) - size
        g, t = self.group[self.own], self.time[self.own]
        if width is None:
            entered = (np.cumsum(own) - own)[self.own] - (np.cumsum(n_own) - n_own)[g]
            left = np.zeros(len(g), np.int64)
        else:
            entered = self._earlier(own, g, t)
            # Where the middle is not empty, no own row lies before a left end.
            left = self._earlier(halo, g, t - width) + self._earlier(own, g, t - width)
        right = n_halo[g] + n_middle[g] + entered
        count = total[g] - n_middle[g] + right - left
        if width is not None:
            right, count = np.where(self.timed[self.own], right, left), np.where(self.timed[self.own], count, 0)
        right = np.where(count > 0, right, left)
        return _medians(values, start[g] + left, start[g] + right, (count - 1) // 2 - below[g], count // 2 - below[g])

    def _earlier(self, rows: np.ndarray, group: np.ndarray, time: np.ndarray) -> np.ndarray:
        """Number of ``rows`` of the group before each time."""
        times = np.unique(self.time[rows])
        step = len(times) + 1
        place = self.group[rows] * step + np.searchsorted(times, self.time[rows])
        found = np.searchsorted(place, group * step + np.searchsorted(times, time))
        return found - np.searchsorted(place, group * step)


def _solve(widths: Sequence[int | None], value: str, keep: Sequence[str], names: Sequence[str]):
    def solved(table: pa.Table) -> pa.Table:
        block = _Block(table, value)
        out = table.select(list(keep)).filter(pa.array(block.own))
        for i, (name, width) in enumerate(zip(names, widths)):
            found = block.medians(i, width)
            out = out.append_column(name, pa.array(found, pa.float64(), mask=np.isnan(found)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < BLOCK_ROWS and sum(b.nbytes for b in waiting) < BLOCK_BYTES:
                continue
            table = pa.Table.from_batches(waiting)
            cut = np.flatnonzero(_numbers(table.column("_rn")) == 1)[-1]  # the last group may go on
            if cut:
                yield from solved(table.slice(0, cut)).to_batches()
                table = table.slice(cut)
            waiting = table.to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting)
            if table.num_rows:
                yield from solved(table).to_batches()

    return run


def past_medians(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    outputs: dict[str, int | None],
    sizes: GroupSizes,
    bins: int = BINS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Adds exact medians of the non-null ``value`` over all earlier rows (``None``) or over ``[t - w, t)``."""
    df = df.withColumn(value, F.col(value).cast("double"))
    rows = solver_rows(df, keys, value, list(outputs.values()), sizes, bins, source)
    group = [*keys, "_stretch"]
    numbered = rows.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group).orderBy("_role", "_output", TIME, ROW, value))
    )
    # What follows reads each group as a run of rows.
    ordered = numbered.sortWithinPartitions(*group, "_rn")
    keep = list(df.columns)
    fields = [df.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in outputs]
    return ordered.mapInArrow(
        _solve(list(outputs.values()), value, keep, list(outputs)), T.StructType([_nullable(f) for f in fields])
    )


def _nullable(field: T.StructField) -> T.StructField:
    return T.StructField(field.name, field.dataType, True)


def solver_rows(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    widths: Sequence[int | None],
    sizes: GroupSizes,
    bins: int = BINS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Own rows of every group (keys, ``_stretch``) and, of hot keys, the halo and middle rows of each output."""
    sizes = grown(sizes)
    extra = {"_output": "int", "_weight": "bigint", "_below": "bigint", "_total": "bigint"}
    own = {"_role": F.lit(OWN), **{c: F.lit(None).cast(kind) for c, kind in extra.items()}}
    cuts = slice_cuts(df if source is None else source, keys, TIME, sizes)
    if cuts is None:
        return df.withColumns({"_stretch": F.lit(COLD_SLICE), **own})
    source = df if source is None else source.withColumn(value, F.col(value).cast("double"))
    points = _points(source, keys, cuts, widths)
    placed = df.join(points, null_safe(df, points, keys), "left")
    stretch = F.when(F.col("_g").isNull(), F.lit(COLD_SLICE)).otherwise(_place("_g"))
    rows = placed.select(*[df[c] for c in df.columns], stretch.alias("_stretch")).withColumns(own)

    # A struct of the keys compares equal where both sides are null, so a null key is a key like any other.
    hot = source.select(F.struct(*keys).alias("_key"), *keys, TIME, ROW, value)
    hot = hot.where(F.col(value).isNotNull()).join(points, null_safe(hot, points, keys))
    filled = hot.select("_key", TIME, ROW, value, _place("_d").alias("_cell"))
    ranked = global_running(filled, ["_key", value, ROW], {"_rank": F.lit(1).cast("bigint")})
    ranked = materialise(ranked.withColumn("_bin", F.floor(F.col("_rank_before") / max(sizes.slice_rows // bins, 1))).drop("_rank_before"))
    spans = materialise(_spans(points, keys, widths))
    halo = _halo(ranked, spans, value)
    middle = _middle(ranked, spans, points, keys, value)
    for part, role in ((halo, HALO), (middle, MIDDLE)):
        part = part.select(*[F.col(f"_key.{k}").alias(k) for k in keys], *[c for c in part.columns if c != "_key"])
        rows = rows.unionByName(part.withColumn("_role", F.lit(role)), allowMissingColumns=True)
    return rows


def _place(points: str) -> Column:
    """Number of points at or before the row's time."""
    return F.size(F.filter(points, lambda c: c <= F.col(TIME)))


def _points(source: DataFrame, keys: Sequence[str], cuts: DataFrame, widths: Sequence[int | None]) -> DataFrame:
    """(``_r_`` keys, _g, _d, _end): where the stretches of each hot key begin, all ends of their spans, the log's end."""
    windows = [F.lit(w).cast("bigint") for w in widths if w is not None]
    shifted = lambda points, by: F.transform(points, lambda c: c + by)
    ends = source.select(*keys, TIME).join(cuts, null_safe(source, cuts, keys), "left_semi")
    ends = ends.groupBy(*keys).agg((F.coalesce(F.max(TIME), F.lit(0)) + 1).alias("_end"))
    known = cuts.join(ends, null_safe(ends, cuts, keys)).drop(*keys)
    begins = F.concat("_cuts", *[shifted("_cuts", w) for w in windows])
    known = known.withColumn("_g", F.array_sort(F.array_distinct(F.filter(begins, lambda c: c < F.col("_end")))))
    every = F.concat("_g", *[shifted(F.concat("_g", F.array("_end")), -w) for w in windows])
    return materialise(known.withColumn("_d", F.array_sort(F.array_distinct(every))).drop("_cuts"))


def _spans(points: DataFrame, keys: Sequence[str], widths: Sequence[int | None]) -> DataFrame:
    """(_key, _stretch, _output) with the cells, from and to, of the own rows, the halo and the middle."""
    key = F.struct(*[F.col(f"_r_{k}").alias(k) for k in keys]).alias("_key")
    begun = F.concat(F.array(F.lit(None).cast("bigint")), "_g")
    rows = points.select(key, "_d", "_g", "_end", F.posexplode(begun).alias("_stretch", "_from"))
    rows = rows.withColumn("_to", F.coalesce(F.get("_g", F.col("_stretch")), "_end"))
    cell = lambda c: F.array_position("_d", c)
    first, last = F.lit(0).cast("bigint"), F.size("_d").cast("bigint") + 1
    begin = F.when(F.col("_from").isNull(), first).otherwise(cell(F.col("_from")))
    end = F.when(F.col("_to") == F.col("_end"), last).otherwise(cell(F.col("_to")))
    spans = []
    for i, width in enumerate(widths):
        if width is None:
            leaving, staying = (first, first), (first, begin)
        else:
            w = F.lit(width).cast("bigint")
            turn = F.least(F.col("_to") - w, F.col("_from"))
            leaving, staying = (cell(F.col("_from") - w), cell(turn)), (cell(turn), begin)
        spans.append(F.struct(F.lit(i).alias("_output"), *[c.alias(n) for n, c in zip(_SPAN, (*leaving, *staying))]))
    out = rows.select("_key", "_stretch", begin.alias("_own_from"), end.alias("_own_to"), F.explode(F.array(*spans)).alias("_s"))
    # The rows before the first point see only each other.
    found = out.select("_key", "_stretch", "_own_from", "_own_to", "_s.*")
    return found.withColumns({c: F.when(F.col("_stretch") == 0, F.lit(0)).otherwise(F.col(c)) for c in _SPAN})


_SPAN = ("_halo_from", "_halo_to", "_middle_from", "_middle_to")


def _cells(spans: DataFrame, part: str) -> DataFrame:
    """(_key, _stretch, _output, _cell) of one part of the spans."""
    some = spans.where(F.col(f"_{part}_to") > F.col(f"_{part}_from"))
    return some.select("_key", "_stretch", "_output", _each_cell(part))


def _each_cell(part: str) -> Column:
    return F.explode(F.sequence(F.col(f"_{part}_from").cast("int"), (F.col(f"_{part}_to") - 1).cast("int"))).alias("_cell")


def _halo(ranked: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """The rows that leave the windows of each stretch."""
    return ranked.join(_cells(spans, "halo"), ["_key", "_cell"]).select("_key", "_stretch", "_output", TIME, ROW, value)


def _middle(ranked: DataFrame, spans: DataFrame, points: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Of the rows between, those that can become the median, as (value, count)."""
    key = F.struct(*[F.col(f"_r_{k}").alias(k) for k in keys]).alias("_key")
    counts = materialise(ranked.groupBy("_key", "_cell", "_bin").agg(F.count(F.lit(1)).alias("_h")))
    # Cells and bins both follow the number of slices, not the rows.
    every = points.select(key, F.explode(F.sequence(F.lit(0), F.size("_d") + 1)).alias("_cell"))
    grid = every.join(counts.select("_key", "_bin").distinct(), "_key").join(counts, ["_key", "_cell", "_bin"], "left")
    earlier = Window.partitionBy("_key", "_bin").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(grid.select("_key", "_cell", "_bin", F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_c")))
    totals = before.groupBy("_key", "_cell").agg(F.sum("_c").alias("_c"))

    def at(rows: DataFrame, end: str, name: str, by_bin: bool = False) -> DataFrame:
        table = (before if by_bin else totals).withColumnRenamed("_cell", end).withColumnRenamed("_c", name)
        table = table.withColumn(end, F.col(end).cast("bigint"))
        return rows.join(table, ["_key", end] + (["_bin"] if by_bin and "_bin" in rows.columns else []))

    def count(rows: DataFrame, part: str, name: str, by_bin: bool = False) -> DataFrame:
        rows = at(at(rows, f"_{part}_from", "_low", by_bin), f"_{part}_to", "_high", by_bin)
        return rows.withColumn(name, F.col("_high") - F.col("_low")).drop("_low", "_high")

    sized = spans
    for part in ("own", "halo", "middle"):
        sized = count(sized, part, f"_n_{part}")
    binned = materialise(sized.where("_n_middle > 0"))
    for part in ("middle", "own", "halo"):
        binned = count(binned, part, f"_in_{part}", by_bin=True)
    lower = Window.partitionBy("_key", "_stretch", "_output").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    under = lambda c: F.coalesce(F.sum(c).over(lower), F.lit(0))
    moves = F.col("_in_own") + F.col("_in_halo")
    running = binned.withColumns({"_moves": moves, "_r": under(F.col("_in_middle")), "_v": under(moves)})
    # With m of the middle and v of the moving values below a place, no median lies above it where 2 m + v exceeds all
    # of the middle and the moving values, and none below it where that is less than the middle.
    start = 2 * F.col("_r") + F.col("_v")
    end = start + 2 * F.col("_in_middle") + F.col("_moves")
    most = F.col("_n_middle") + F.col("_n_own") + F.col("_n_halo")
    reached = running.where((end > F.col("_n_middle") - 2) & (start <= most + 1) & (F.col("_in_middle") > 0))
    whole = Window.partitionBy("_key", "_stretch", "_output")
    wanted = reached.withColumn("_below", F.min("_r").over(whole))
    wanted = wanted.select("_key", "_stretch", "_output", "_bin", "_below", F.col("_n_middle").alias("_total"), _each_cell("middle"))
    filled = wanted.join(counts.drop("_h"), ["_key", "_cell", "_bin"])
    found = ranked.select("_key", "_cell", "_bin", value).join(filled, ["_key", "_cell", "_bin"])
    return found.groupBy("_key", "_stretch", "_output", value, "_below", "_total").agg(F.count(F.lit(1)).alias("_weight"))
