"""Dimension joins and id-aligned vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import calendar_parts, date_from_int, rename_prefixed, time_from_millis, time_from_text
from tidemark.operators.dedup import latest_row, most_frequent
from tidemark.operators.encoders import label_encode
from tidemark.operators.skew import dense_index

# Encoded columns of the raw dimension tables.
PROFILE = ["age", "gender", "country", "device_brand", "device_price", "reg_timestamp"]
USER_CODES = [
    "user_age", "user_gender", "user_country", "user_device_brand", "user_device_price",
    "fans_num", "follow_num", "accu_watch_live_cnt", "accu_watch_live_duration",
]
STREAMER_CODES = [
    "streamer_age", "streamer_gender", "streamer_country", "streamer_device_brand", "streamer_device_price",
    "live_operation_tag", "fans_user_num", "fans_group_fans_num", "follow_user_num",
    "accu_live_cnt", "accu_live_duration", "accu_play_cnt", "accu_play_duration",
]


def merge_dimensions(
    facts: DataFrame,
    user: DataFrame,
    room: DataFrame,
    streamer: DataFrame,
    user_key: str = "user_id",
    streamer_key: str = "streamer_id",
    room_keys: Sequence[str] = ("streamer_id", "live_id"),
) -> DataFrame:
    """Left joins of facts with users and with rooms enriched by their streamer.

    Rooms and streamers meet first, so the fact table crosses the network once
    per side.  Small dimensions are broadcast from their measured size; for
    large ones the oversized fact keys are split at run time.
    """
    rooms = room.join(streamer, streamer_key, "left")
    return facts.join(user, user_key, "left").join(rooms, list(room_keys), "left")


def _profile(df: DataFrame, prefix: str, codes: Sequence[str], times: Sequence[str]) -> DataFrame:
    out = df.withColumns({c: time_from_text(c) for c in times if c in df.columns})
    out = rename_prefixed(out, [*PROFILE, *[f"onehot_feat{i}" for i in range(7)]], prefix)
    return label_encode(out, [c for c in codes if c in out.columns])


def user_dimension(df: DataFrame) -> DataFrame:
    return _profile(df, "user_", USER_CODES, ["reg_timestamp", "first_watch_live_timestamp"])


def streamer_dimension(df: DataFrame) -> DataFrame:
    return _profile(df, "streamer_", STREAMER_CODES, ["reg_timestamp", "first_live_timestamp"])


def aligned_vectors(ids: DataFrame, id_col: str, vectors: DataFrame, row_col: str = "row_id") -> DataFrame:
    """Vector ``i`` belongs to the ``i``-th sorted distinct id other than -1."""
    known = ids.select(id_col).where(F.col(id_col).isNotNull() & (F.col(id_col) != -1)).distinct()
    placed = dense_index(known, [id_col], "_row")
    return placed.join(vectors, placed["_row"] == vectors[row_col]).select(id_col, "embedding")


def attach_vectors(df: DataFrame, id_col: str, vectors: DataFrame, width: int, prefix: str = "title_emb") -> DataFrame:
    """Left join of one vector per id with a missing flag and a zero vector where none exists."""
    joined = df.join(vectors.withColumnRenamed("embedding", "_vec"), id_col, "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return joined.select(
        *df.columns,
        F.col("_vec").isNull().cast("int").alias(f"{prefix}_missing"),
        F.coalesce("_vec", zero).alias(prefix),
    )


def room_dimension(df: DataFrame, vectors: DataFrame | None = None, width: int = 128) -> DataFrame:
    """One row per live: latest start, most frequent title, calendar parts, category code, title vector."""
    times = {c: time_from_millis(c) for c in ("start_timestamp", "end_timestamp")}
    out = df.withColumns({"p_date": date_from_int("p_date"), **times})
    out = label_encode(out, ["live_content_category"]).withColumn("_t", F.unix_micros("start_timestamp"))
    out = out.select("*", *calendar_parts("start_timestamp", "live_start")).withColumnRenamed(
        "live_start_is_weekend", "live_is_weekend"
    )
    titles = most_frequent(out, "live_id", "live_name_id", "_t")
    # Rows of one live with one start time differ in nothing that is kept apart from the title.
    rooms = latest_row(out.withColumn("_h", F.xxhash64(*out.columns)), ["live_id"], "_t", "_h").drop("live_name_id", "_h")
    rooms = rooms.join(titles, "live_id", "left").drop("_t")
    if vectors is None:
        return rooms
    return attach_vectors(rooms, "live_name_id", aligned_vectors(df, "live_name_id", vectors), width)
