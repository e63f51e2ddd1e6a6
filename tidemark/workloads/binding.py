"""Roles of the given tables: how events, orders, vectors and labels stand in for the recommender's inputs.

Every query reads whole tables.  The SQL text of each role is the twin of the
DataFrame next to it and is used by the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators.attribution import build_interactions
from tidemark.session import configure

SPLIT = {"train": ("2024-01-01", "2024-01-18"), "val": ("2024-01-19", "2024-01-22"), "test_from": "2024-01-23"}
FOLLOWUPS = {"signup": "like", "error": "comment", "purchase": "gift"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Event log with the three ids taken from the event's properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("imp_timestamp"),
        micros("ts").alias("t_us"),
        "user_id",
        (k % 20).alias("live_id"),
        (k % 5).alias("streamer_id"),
        "event_type",
        "value",
    )


def clicks(ev: DataFrame) -> DataFrame:
    return (
        ev.where(F.col("event_type") == "click")
        .withColumn("watch_live_time", F.col("value"))
        .drop("event_type", "value")
    )


def negatives(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type") == "view").drop("event_type", "value")


def followups(ev: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for event, name in FOLLOWUPS.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return (
        ev.where(F.col("event_type").isin(*FOLLOWUPS))
        .withColumn("kind", kind)
        .withColumn("amount", F.when(F.col("kind") == "gift", F.col("value")))
        .drop("event_type", "value", "imp_timestamp")
    )


def with_category(df: DataFrame) -> DataFrame:
    """Category of a live; one in four lives has none."""
    return df.withColumn("live_content_category_le", F.nullif(F.col("live_id") % 4, F.lit(3)))


def impressions(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks and views with the click label, without attribution."""
    ev = events(spark, sf).where(F.col("event_type").isin("click", "view"))
    is_click = (F.col("event_type") == "click").cast("int")
    return with_category(
        ev.withColumn("is_click", is_click)
        .withColumn("watch_live_time", F.when(is_click == 1, F.col("value")).otherwise(0.0))
        .drop("event_type", "value")
    )


def interactions(spark: SparkSession, sf: str, **options) -> DataFrame:
    ev = events(spark, sf)
    return with_category(build_interactions(clicks(ev), negatives(ev), followups(ev), **options))


EV = """ev AS (
  SELECT event_id, ts, epoch_us(ts) AS t_us, user_id, k % 20 AS live_id, k % 5 AS streamer_id, event_type, value
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

IMP = (
    EV
    + """,
imp AS (
  SELECT event_id, ts, t_us, user_id, live_id, streamer_id, nullif(live_id % 4, 3) AS cat,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
         CASE WHEN event_type = 'click' THEN value ELSE 0 END AS watch_live_time,
         CASE WHEN event_type = 'click' THEN value END AS w
  FROM ev WHERE event_type IN ('click', 'view'))"""
)

INTER = (
    IMP
    + """,
fu AS (
  SELECT f.event_id, f.t_us, f.value,
         CASE f.event_type WHEN 'signup' THEN 'like' WHEN 'error' THEN 'comment' ELSE 'gift' END AS kind,
         c.event_id AS click_id
  FROM (SELECT * FROM ev WHERE event_type IN ('signup', 'error', 'purchase')) f
  ASOF JOIN (SELECT * FROM ev WHERE event_type = 'click') c
    ON f.user_id = c.user_id AND f.live_id = c.live_id AND f.streamer_id = c.streamer_id AND f.t_us >= c.t_us),
att AS (
  SELECT click_id, max(t_us) FILTER (kind = 'like') AS latest_like_us,
         max(t_us) FILTER (kind = 'comment') AS latest_comment_us,
         max(t_us) FILTER (kind = 'gift') AS latest_gift_us,
         max_by(value, t_us) FILTER (kind = 'gift') AS gift_price
  FROM fu GROUP BY click_id),
inter AS (
  SELECT imp.*, latest_like_us, latest_comment_us, latest_gift_us,
         CASE WHEN latest_like_us IS NULL THEN 0 ELSE 1 END AS is_like,
         CASE WHEN latest_comment_us IS NULL THEN 0 ELSE 1 END AS is_comment,
         CASE WHEN latest_gift_us IS NULL THEN 0 ELSE 1 END AS is_gift,
         coalesce(gift_price, 0) AS gift_price
  FROM imp LEFT JOIN att ON imp.event_id = att.click_id)"""
)


def split_sql(ts: str) -> str:
    return (
        f"CASE WHEN CAST({ts} AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-18' THEN 'train' "
        f"WHEN CAST({ts} AS DATE) BETWEEN DATE '2024-01-19' AND DATE '2024-01-22' THEN 'val' "
        f"WHEN CAST({ts} AS DATE) >= DATE '2024-01-23' THEN 'test' END"
    )


# Order lines as a second log: customer = user, part = item, supplier = streamer.
def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).drop("o_orderkey")


LINES = "fact AS (SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that two engines' sums compare equal."""
    return df.select(
        *[
            # Adding 0 turns a negative zero into zero.
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
