"""Session settings shared by every job."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A fact row's user, live or streamer may be very popular: let AQE cut the
    # oversized side of a join even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Broadcasts are chosen by Spark from measured sizes only.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # Shuffled rows shrink to some 13 bytes and take twenty times as much once a task sorts or hashes them: partitions
    # are merged up to this size only, so that a task holds some 200 MB and a larger input means more tasks.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # The same for tasks that read files and fold or sort what they read.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Settled when a session is built; plans of many columns are put together faster without call-site capture.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate data: ``spark.checkpoint.dir``, else one below the warehouse.

    Both are folders that a cluster shares between its driver and executors;
    no temporary folder of one machine is ever used.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scratch_database(spark: SparkSession) -> str:
    """Database of this application's intermediate tables; its files lie in the shared folder."""
    name = "scratch_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_folder(spark)}/{name}'")
        atexit.register(_drop_at_exit, name)
    return name


def new_table_name(spark: SparkSession) -> str:
    return f"{scratch_database(spark)}.t_{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table that several branches read to the shared folder and read it back.

    Cuts the lineage on reliable storage and, unlike a row checkpoint, keeps
    column pruning.  The files lie in the scratch database's folder, without an
    entry in the catalog, and go with it: see ``drop_intermediate``.
    """
    spark = df.sparkSession
    database, table = new_table_name(spark).split(".")
    path = f"{shared_folder(spark)}/{database}/{table}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, column: str) -> DataFrame:
    """A stored table that lies in buckets of a column: tables stored this way meet on it without an exchange."""
    spark = df.sparkSession
    name, buckets = new_table_name(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, column)  # one file for each bucket
    dealt.write.format("parquet").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return spark.table(name)


def drop_intermediate(spark: SparkSession) -> None:
    """Drop every intermediate table of this application, files included; results built on them become unreadable."""
    name = "scratch_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def _drop_at_exit(name: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:  # not stopped yet
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
