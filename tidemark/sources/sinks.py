"""Sinks: partitioned splits, result tables, metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """One folder per split, fresh on each run; rows outside every split are left out."""
    writer = df.where(F.col(split_col).isNotNull()).write.mode("overwrite").partitionBy(split_col)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result table: candidates, scores, ranked lists, recall by user."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    if fmt == "csv":
        for name in arrays:
            df = df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), "|"))
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def metric_report(metrics: DataFrame, section: str = "section") -> DataFrame:
    """Long ``(section, metric, value)`` rows to one JSON document.

    A report holds a fixed number of metric names per section, so the group
    that is collected here does not grow with the data.
    """
    per_section = metrics.groupBy(section).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    by_name = lambda a, b: F.when(a[section] < b[section], -1).when(a[section] > b[section], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct(section, "metrics")), by_name)
    return per_section.agg(F.to_json(F.map_from_entries(listed)).alias("report"))


def write_report(metrics: DataFrame, path: str, section: str = "section") -> None:
    metric_report(metrics, section).write.mode("overwrite").text(path)
