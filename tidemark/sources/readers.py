"""Scans: named tables, vector tables, pruned and filtered reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import RAW_SCHEMAS, require_columns


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None
) -> DataFrame:
    """One table (S4): a plain partitioned scan, pruned to ``columns``."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError(f"a CSV source needs a declared schema: {path}")
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_tables(
    spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str] = RAW_SCHEMAS, views: bool = True
) -> dict[str, DataFrame]:
    """Named tables (S1): one DataFrame, and one temporary view, per name."""
    tables = {name: read_table(spark, path, schema=schemas.get(name)) for name, path in paths.items()}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def load_directory(spark: SparkSession, folder: str, schemas: Mapping[str, str] = RAW_SCHEMAS) -> dict[str, DataFrame]:
    """Every CSV or Parquet entry of a folder as a table named by its stem."""
    # Only the paths are read: the entries of the folder are the first part of each file's path below it.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    place = folder.split("://")[-1].removeprefix("file:").rstrip("/").removeprefix("./") + "/"
    begin = F.instr("path", place) + len(place)
    name = F.substring_index(F.substring(F.col("path"), begin, F.length("path")), "/", 1)
    entry = F.concat(F.substring(F.col("path"), F.lit(1), begin - 1), name)
    paths = {}
    for row in listed.select(entry.alias("path")).distinct().collect():
        if row["path"].endswith((".csv", ".parquet")):
            paths[Path(row["path"]).stem] = row["path"]
    return load_tables(spark, dict(sorted(paths.items())), schemas)


def read_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vector table (S2): ``(id, vector array<float>)``; empty vectors become null."""
    vector = F.col(vector_col).cast("array<float>")
    return df.select(F.col(id_col).alias("id"), F.when(F.size(vector) > 0, vector).alias("vector"))


def flatten_vectors(df: DataFrame, vector_col: str, width: int, prefix: str = "title_emb_") -> DataFrame:
    """Array column to ``width`` scalar columns, for sinks that need a flat file."""
    flat = [F.get(vector_col, F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]
    return df.select(*[c for c in df.columns if c != vector_col], *flat)


def scan_where(df: DataFrame, columns: Sequence[str], condition: Column) -> DataFrame:
    """Pruned and filtered scan (S3): both reach the file reader."""
    return require_columns(df, columns).where(condition).select(*columns)


def scan_counts(df: DataFrame, condition: Column) -> DataFrame:
    """Rows scanned and rows kept by a filter, in one pass (S3)."""
    return df.agg(F.count(F.lit(1)).alias("rows_scanned"), F.count_if(condition).alias("rows_kept"))
