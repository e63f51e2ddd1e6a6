"""From raw tables to the scaled feature table: the feature stage as one declarative job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import drop_incomplete, micros, repeatable_sample, time_from_millis
from tidemark.operators.attribution import KINDS, build_interactions
from tidemark.operators.dimensions import merge_dimensions, room_dimension, streamer_dimension, user_dimension
from tidemark.plans.features import build_features, context_features, measure_keys
from tidemark.session import materialise

EVENT_KEYS = ["user_id", "live_id", "streamer_id"]


def _events(df: DataFrame, extra: dict | None = None) -> DataFrame:
    typed = df.withColumn("imp_timestamp", time_from_millis("timestamp")).drop("timestamp")
    clean = drop_incomplete(typed, EVENT_KEYS, "imp_timestamp")
    # Row id that every engine and run agrees on; equal rows are equal in all features too.
    named = clean.withColumn("event_id", F.xxhash64(*sorted(clean.columns)))
    return named.withColumn("t_us", micros("imp_timestamp")).withColumns(extra or {})


def raw_interactions(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    """Click, negative, like, comment and gift tables to labelled impressions."""
    followups = None
    for kind in KINDS:
        amount = F.col("gift_price") if kind == "gift" else F.lit(None)
        part = _events(tables[kind], {"kind": F.lit(kind), "amount": amount.cast("double")}).drop(
            "imp_timestamp", "gift_price"
        )
        followups = part if followups is None else followups.unionByName(part)
    return build_interactions(_events(tables["click"]), _events(tables["negative"]), followups, **options)


def build_feature_table(
    tables: Mapping[str, DataFrame], vector_width: int = 128, sample: float = 1.0, seed: int = 42
) -> DataFrame:
    """Interactions, dimensions, ages and the window features; the sample is drawn last."""
    interactions = raw_interactions(tables)
    rooms = materialise(room_dimension(tables["room"], tables.get("title_embeddings"), vector_width))
    category = rooms.select("streamer_id", "live_id", "live_content_category_le")
    # Read by the size check and by every key's features.
    narrow = materialise(interactions.join(category, ["streamer_id", "live_id"], "left"))
    featured = build_features(narrow, sizes=measure_keys(narrow)).drop("live_content_category_le")
    wide = merge_dimensions(
        featured, user_dimension(tables["user"]), rooms, streamer_dimension(tables["streamer"])
    )
    times = {
        "user_reg_us": "user_reg_timestamp", "first_watch_live_us": "first_watch_live_timestamp",
        "start_us": "start_timestamp", "streamer_reg_us": "streamer_reg_timestamp",
        "first_live_us": "first_live_timestamp",
    }
    wide = context_features(wide.withColumns({n: micros(c) for n, c in times.items() if c in wide.columns}))
    return repeatable_sample(wide.drop(*times), sample, "event_id", seed=seed)
