"""Declared schemas of the raw tables and the name check used before a job runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

_EVENT = "user_id BIGINT, live_id BIGINT, streamer_id BIGINT, timestamp BIGINT"
_ONEHOT = ", ".join(f"onehot_feat{i} INT" for i in range(7))

RAW_SCHEMAS = {
    "click": _EVENT + ", watch_live_time DOUBLE",
    "negative": _EVENT,
    "like": _EVENT,
    "comment": _EVENT,
    "gift": _EVENT + ", gift_price DOUBLE",
    "user": (
        "user_id BIGINT, age STRING, gender STRING, country STRING, device_brand STRING, device_price STRING, "
        "reg_timestamp STRING, first_watch_live_timestamp STRING, fans_num STRING, follow_num STRING, "
        "accu_watch_live_cnt STRING, accu_watch_live_duration STRING, is_live_streamer INT, is_photo_author INT, "
        + _ONEHOT
    ),
    "room": (
        "p_date INT, live_id BIGINT, streamer_id BIGINT, live_type INT, live_content_category STRING, "
        "live_name_id BIGINT, start_timestamp BIGINT, end_timestamp BIGINT"
    ),
    "streamer": (
        "streamer_id BIGINT, age STRING, gender STRING, country STRING, device_brand STRING, device_price STRING, "
        "reg_timestamp STRING, first_live_timestamp STRING, live_operation_tag STRING, fans_user_num STRING, "
        "fans_group_fans_num STRING, follow_user_num STRING, accu_live_cnt STRING, accu_live_duration STRING, "
        "accu_play_cnt STRING, accu_play_duration STRING, " + _ONEHOT
    ),
    "title_embeddings": "row_id BIGINT, embedding ARRAY<FLOAT>",
}


def require_columns(df: DataFrame, columns: Iterable[str], source: str = "<dataframe>") -> DataFrame:
    """Fail before any job starts when a needed column is absent."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns in {source}: {missing}")
    return df
