"""Incremental click-priority de-duplication on a stream (ST1).

The best row of a key is the smallest order struct, an associative and
commutative choice, so the stream itself keeps no state that could grow: each
micro-batch is reduced on its own and written as a *run*, and runs are merged
by the same choice.  Run lengths follow a binary counter: whenever the batches
up to now fill a power of two, the runs of that stretch become one.  So a row is
rewritten at most once for each doubling of the number of batches, what a merge
writes follows the changes it merges, and a reader meets a logarithmic number
of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.dedup import KEYS, best_row, click_priority_order


def _tables(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(first, last) batch of every run of the target."""
    database, _, name = target.rpartition(".")
    prefix = f"{name}_run_"
    names = [t.name for t in spark.catalog.listTables(database or None) if t.name.startswith(prefix)]
    return [tuple(map(int, n.removeprefix(prefix).split("_"))) for n in names]


def _inside(run: tuple[int, int], other: tuple[int, int]) -> bool:
    return run != other and other[0] <= run[0] and run[1] <= other[1]


def live_runs(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """The runs that count: those that lie in no longer one, in order."""
    runs = _tables(spark, target)
    return sorted(r for r in runs if not any(_inside(r, other) for other in runs))


def _name(target: str, run: tuple[int, int]) -> str:
    return f"{target}_run_{run[0]}_{run[1]}"


def _merged(spark: SparkSession, target: str, runs: Sequence[tuple[int, int]], keys: Sequence[str], order) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [spark.table(_name(target, r)) for r in runs])
    return best_row(rows, keys, order)


def upsert_sink(
    target: str, keys: Sequence[str] = KEYS, time_us: str = "t_us", row_id: str = "event_id"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: the best rows of each micro-batch, merged with earlier runs as a binary counter carries.

    Re-running a batch overwrites its run, or adds one that a longer run already
    covers, so a retry cannot duplicate rows.  The runs that a merge replaces
    are dropped only after it is written, and readers skip them, so a job that
    dies in between leaves a readable target.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, order = batch.sparkSession, click_priority_order(time_us, row_id)
        best_row(batch, keys, order).write.mode("overwrite").saveAsTable(_name(target, (batch_id, batch_id)))
        length = (batch_id + 1) & -(batch_id + 1)  # the power of two that this batch completes
        stretch = (batch_id + 1 - length, batch_id)
        parts = [r for r in live_runs(spark, target) if _inside(r, stretch)]
        if len(parts) > 1:
            _merged(spark, target, parts, keys, order).write.mode("overwrite").saveAsTable(_name(target, stretch))
        runs = _tables(spark, target)
        for run in runs:
            if any(_inside(run, other) for other in runs):
                spark.sql(f"DROP TABLE IF EXISTS {_name(target, run)}")

    return write


def start_incremental(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = KEYS, time_us: str = "t_us", row_id: str = "event_id"
):
    """Run the stream over everything available; ``target`` names the runs."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(upsert_sink(target, keys, time_us, row_id))
        .start()
    )


def current_best(
    spark: SparkSession, target: str, keys: Sequence[str] = KEYS, time_us: str = "t_us", row_id: str = "event_id"
) -> DataFrame:
    """Best row per key over everything written so far."""
    return _merged(spark, target, live_runs(spark, target), keys, click_priority_order(time_us, row_id))
