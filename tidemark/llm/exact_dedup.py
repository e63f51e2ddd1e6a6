"""Exact de-duplication against a persistent digest index (operator 1).

The index is a table bucketed and sorted by the SHA-256 of the text without
white space.  A batch of documents is folded to one row per digest on the map
side, joined against the index by a sort-merge anti-join that does not shuffle
the index, and what is new is appended.  All of it is DataFrame work.

Defined cases: a null text is an empty one, and all empty texts are copies of
each other; the row with the most code points stays, then the smallest
``doc_id``, a null id last; rows that repeat both id and text are one document
and share its answer; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, attach, text_of
from tidemark.session import materialise, new_table_name


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without white space, in UTF-8."""
    return F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, chars) of every document."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        digest(text_of(text)).alias("digest"),
        F.char_length(text_of(text)).cast("bigint").alias("chars"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its length, and the group's size; combined before the shuffle."""
    best = F.min(F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id")))
    return (
        rows.groupBy("digest")
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("_best.doc_id").alias("keep_id"), (-F.col("_best.shorter")).alias("chars"), "group_size")
    )


class DigestIndex:
    """Table of known digests, bucketed and sorted by digest.

    A text that is already known keeps the document it was first appended
    with; ``group_size`` counts the copies in that batch.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or new_table_name(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, chars BIGINT, group_size BIGINT) "
                f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Groups of a batch of ``digests`` whose text the index does not hold."""
        batch, known = groups(rows), self.rows().select("digest")
        return batch.hint("merge").join(known, "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        new = self.fresh(rows).repartition(self.buckets, "digest")
        new.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``digests``, all of them indexed before."""
        found = attach(rows, self.rows(), ["digest"], "group_size", ["keep_id", "group_size"])
        return found.select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which document stands for each text: one row per document."""
    spark = docs.sparkSession
    rows = materialise(digests(docs))
    index = DigestIndex(spark)
    index.append(rows)
    return index.resolve(rows)


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns, one row for each text."""
    spark = docs.sparkSession
    index = DigestIndex(spark)
    index.append(digests(docs))
    # The key holds id and length: of a hot group only the row that stays, and rows repeating it, meet here.
    id_key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("absent")]
    size = F.char_length(text_of()).cast("bigint").alias("chars")
    # The row travels as one value, so that its columns may have any names.
    own = docs.select(F.struct("*").alias("whole"), *id_key, digest(text_of()).alias("digest"), size)
    keep = index.rows().select(
        F.coalesce("keep_id", F.lit(0)).alias("id"), F.col("keep_id").isNull().alias("absent"), "digest", "chars"
    )
    key = ["id", "absent", "digest", "chars"]
    return own.join(keep, key, "left_semi").dropDuplicates(key).select("whole.*")
