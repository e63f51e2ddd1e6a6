"""Column helpers and the skew-safe lookup shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group counts as hot from this share of all rows on, so there are at most as many hot groups.
HOT_GROUPS = 1024
#: A group of fewer rows is never hot.
HOT_ROWS = 64
#: Whole texts in one Arrow batch.
TEXTS = 2_000


def whole_texts(docs: DataFrame) -> DataFrame:
    """Documents for a Python pass over whole texts: the session sends at most TEXTS of them at a time.

    Spark's own bound counts rows (10,000), and a task holds a few batches in the JVM and in Python.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXTS:
        conf.set(name, str(TEXTS))
    return docs


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(-1))


def row_digest() -> Column:
    """A digest of a row's id and text: rows that differ in either are told apart."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", F.col("doc_id").isNull().cast("int"), F.length(name), name, text_of()).cast("binary"), 256)


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """All columns of the documents with a digest in ``kept`` (row); rows of one id and text are one row."""
    kept = materialise(kept.select(F.col("row").alias("wanted")))
    # The row travels as one value, so that its columns may have any names.
    marked = docs.select(F.struct("*").alias("whole"), row_digest().alias("row"))
    found = marked.join(kept, marked["row"] == kept["wanted"], "left_semi")
    return found.dropDuplicates(["row"]).select("whole.*")


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, columns: Sequence[str]) -> DataFrame:
    """Adds ``columns`` of the row's group, where a group may hold a large part of all rows.

    ``groups`` has one row for each non-null key of ``rows``, with its number
    of rows in ``size``; it is read three times and should be a stored table.
    Groups of at least 1/1024 of all rows, and of HOT_ROWS - 1,024 at most,
    whatever the input - are broadcast; the rest meet in a shuffled join, in
    which the rows already answered are spread by a key of their own.
    """
    counted = groups.agg(F.sum(size).alias("total"), F.max(size).alias("most")).first()
    least = max(-(-(counted["total"] or 0) // HOT_GROUPS), HOT_ROWS)
    if (counted["most"] or 0) < least:
        named = groups.select(*[F.col(k).alias(f"_cold_{k}") for k in keys], F.struct(*columns).alias("_found"))
        joined = rows.join(named, [rows[k] == named[f"_cold_{k}"] for k in keys], "left")
        return joined.select(*[rows[c] for c in rows.columns], *[named["_found"][c].alias(c) for c in columns])
    hot = groups.where(F.col(size) >= least).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.struct(*columns).alias("_hot")
    )
    on_hot = [rows[k] == hot[f"_hot_{k}"] for k in keys]
    marked = rows.join(F.broadcast(hot), on_hot, "left").drop(*[f"_hot_{k}" for k in keys])
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(2**30)) + 1
    kind = rows.schema[keys[0]].dataType
    # The first key itself is replaced: a bucketed table of groups makes Spark deal by that key alone.
    marked = marked.withColumns(
        {
            "_spread": F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(spread),
            "_first": F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(spread.cast(kind)),
        }
    )
    cold = groups.where(F.col(size) < least).select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        F.lit(0).cast("bigint").alias("_none"),
        F.struct(*columns).alias("_cold"),
    )
    on_cold = [marked["_first"] == cold[f"_cold_{keys[0]}"], marked["_spread"] == cold["_none"]]
    joined = marked.join(cold, on_cold + [marked[k] == cold[f"_cold_{k}"] for k in keys[1:]], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*[marked[c] for c in rows.columns], *[found[c].alias(c) for c in columns])
