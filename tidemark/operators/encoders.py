"""Category codes and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, to_number
from tidemark.operators.skew import RANGE_ROWS, dense_index
from tidemark.session import materialise


def sorted_codes(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """(value, code) with codes in value order, for a vocabulary of any size."""
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    return dense_index(values, ["value"], "code", start)


def label_encode(
    df: DataFrame, columns: Sequence[str], suffix: str = "_le", fit_on: DataFrame | None = None
) -> DataFrame:
    """Adds ``<column>_le``: 0..n-1 in value order, null or unseen -1.

    The distinct (column, value) cells of all columns of a type come from one
    pass and are stored.  A column is numbered in one window while its values
    fit one task, and across ranges beyond.
    """
    source, by_type = df if fit_on is None else fit_on, {}
    for c in columns:
        by_type.setdefault(source.schema[c].dataType.simpleString(), []).append(c)
    out = df
    for names in by_type.values():
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_at"), F.col(c).alias("_value")) for i, c in enumerate(names)]))
        distinct = source.select(cells.alias("s")).select("s.*").where(F.col("_value").isNotNull()).distinct()
        # Counted by the job that writes.
        seen = Observation()
        distinct = materialise(distinct.observe(seen, *[F.count_if(F.col("_at") == i).alias(f"n{i}") for i in range(len(names))]))
        counts = seen.get
        for i, c in enumerate(names):
            values = distinct.where(F.col("_at") == i).select("_value")
            if counts[f"n{i}"] <= RANGE_ROWS:
                place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_value")).cast("bigint") - 1
                codes = values.select("_value", place.alias("_code"))
            else:
                codes = dense_index(values, ["_value"], "_code")
            joined = out.join(codes, out[c] == codes["_value"], "left")
            code = F.coalesce("_code", F.lit(-1).cast("bigint")).alias(c + suffix)
            out = joined.select(*[out[x] for x in out.columns], code)
    return out


def as_token(column: str):
    """Category text; a missing value is a category of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def vocabulary(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """(token, id) over several tables, ids 1..n in token order."""
    union = frames[0].select(as_token(column).alias("token"))
    for other in frames[1:]:
        union = union.unionByName(other.select(as_token(column).alias("token")))
    return dense_index(union.distinct(), ["token"], "id", 1)


def encode_vocabulary(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """Vocabulary id of a column, unseen 0."""
    names = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    joined = df.join(names, as_token(column) == names["_token"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("_id", F.lit(0)).alias(out))


def _safe_id(column: str):
    value = to_number(column, "bigint", 0)
    return F.when(value < 0, F.lit(0)).otherwise(value)


def category_sizes(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(column, size) with size = largest id + 1 over all tables, in one pass each."""
    union = frames[0].select(*columns)
    for other in frames[1:]:
        union = union.unionByName(other.select(*columns))
    row = union.agg(*[(F.max(_safe_id(c)) + 1).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "size")


def clamp_categories(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Ids to [0, size - 1]; bad or missing ids to 0."""
    return df.withColumns({c: clip(_safe_id(c), 0, size - 1) for c, size in sizes.items()})
