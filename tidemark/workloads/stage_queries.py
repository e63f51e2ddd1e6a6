"""The whole feature stage from raw-shaped tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.feature_table import build_feature_table
from tidemark.workloads import binding as b

WIDTH = 64


def raw_tables(spark, sf) -> dict:
    """Event, dimension and vector tables with the raw column names and types."""
    ev = b.events(spark, sf)
    keys = ["user_id", "live_id", "streamer_id", F.floor(F.col("t_us") / 1000).alias("timestamp")]

    def log(event, *extra):
        return ev.where(F.col("event_type") == event).select(*keys, *extra)

    cust, supp = b.table(spark, sf, "customer"), b.table(spark, sf, "supplier")
    text = lambda e: e.cast("string")
    stamp = lambda e: F.date_format(F.timestamp_seconds(F.lit(1672531200) + e), "yyyy-MM-dd HH:mm:ss")
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    day = F.col("imp_timestamp").cast("date")
    return {
        "click": log("click", F.col("value").alias("watch_live_time")),
        "negative": log("view"),
        "like": log("signup"),
        "comment": log("error"),
        "gift": log("purchase", F.col("value").alias("gift_price")),
        "user": cust.select(
            k.alias("user_id"), text(k % 7).alias("age"), text(k % 2).alias("gender"),
            text(F.col("c_nationkey")).alias("country"), F.col("c_mktsegment").alias("device_brand"),
            text(F.floor(F.col("c_acctbal") / 1000)).alias("device_price"), stamp(k * 3600).alias("reg_timestamp"),
            stamp(k * 7200).alias("first_watch_live_timestamp"), text(k % 9).alias("fans_num"),
        ),
        "streamer": supp.select(
            s.alias("streamer_id"), text(s % 5).alias("age"), text(F.col("s_nationkey")).alias("country"),
            stamp(s * 86400).alias("reg_timestamp"), F.lit("not a time").alias("first_live_timestamp"),
            text(F.floor(F.col("s_acctbal") / 1000)).alias("accu_play_cnt"),
        ),
        "room": ev.select("live_id", "streamer_id", day.alias("d")).distinct().select(
            "live_id", "streamer_id",
            F.date_format("d", "yyyyMMdd").cast("int").alias("p_date"),
            (F.unix_seconds(F.col("d").cast("timestamp")) * 1000 + F.col("live_id") * 60000).alias("start_timestamp"),
            F.lit(None).cast("bigint").alias("end_timestamp"),
            (F.col("live_id") % 4).cast("int").alias("live_type"),
            F.when(F.col("live_id") % 5 != 0, F.concat(F.lit("c"), F.col("live_id") % 4)).alias("live_content_category"),
            ((F.col("live_id") + F.dayofmonth("d")) % 3 - 1).alias("live_name_id"),
        ),
        "title_embeddings": b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding"),
    }


COLUMNS = [
    "user_id", "live_id", "streamer_id", "t_us", "is_click", "is_like", "is_comment", "is_gift", "gift_price",
    "num_imp_user_7d", "num_imp_room_1d", "num_imp_user_category_7d", "user_country_le", "user_device_brand_le",
    "streamer_country_le", "live_name_id", "live_content_category_le", "title_emb_missing", "user_account_age",
    "streamer_account_age", "streamer_live_age", "time_since_live_start",
]


def feature_table(spark, sf):
    return b.rounded(build_feature_table(raw_tables(spark, sf), WIDTH).select(*COLUMNS))


QUERIES = {"F_feature_table": feature_table}

_MS = b.INTER.replace("epoch_us(ts) AS t_us", "epoch_us(ts) // 1000 * 1000 AS t_us")
SQL = {
    "F_feature_table": f"""WITH {_MS},
lv AS (SELECT DISTINCT live_id, streamer_id, CAST(ts AS DATE) AS d FROM ev),
nm AS (SELECT live_id, (live_id + day(d)) % 3 - 1 AS name, count(*) AS n, max(d) AS t FROM lv GROUP BY ALL),
best AS (SELECT live_id, name FROM nm QUALIFY row_number() OVER (PARTITION BY live_id ORDER BY n DESC, t DESC, name) = 1),
ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS rid FROM (SELECT DISTINCT name FROM nm WHERE name <> -1)),
room AS (SELECT live_id, max(epoch_us(d) + live_id * 60000000) AS start_us FROM lv GROUP BY live_id),
cats AS (SELECT cat2, row_number() OVER (ORDER BY cat2) - 1 AS code FROM (SELECT DISTINCT 'c' || (live_id % 4) AS cat2 FROM lv WHERE live_id % 5 <> 0)),
cu AS (SELECT c_custkey, dense_rank() OVER (ORDER BY CAST(c_nationkey AS VARCHAR)) - 1 AS cc, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS bb FROM customer),
su AS (SELECT s_suppkey, dense_rank() OVER (ORDER BY CAST(s_nationkey AS VARCHAR)) - 1 AS sc FROM supplier),
base AS (SELECT i.*, coalesce(code, -1) AS cat_code FROM inter i LEFT JOIN cats ON i.live_id % 5 <> 0 AND cat2 = 'c' || (i.live_id % 4))
SELECT user_id, live_id, streamer_id, t_us, is_click, is_like, is_comment, is_gift, round(gift_price, 6) AS gift_price,
  count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS num_imp_user_7d,
  count(*) OVER (PARTITION BY live_id ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS num_imp_room_1d,
  count(*) OVER (PARTITION BY user_id, cat_code ORDER BY t_us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS num_imp_user_category_7d,
  cc AS user_country_le, bb AS user_device_brand_le, sc AS streamer_country_le,
  name AS live_name_id, cat_code AS live_content_category_le, CAST(v.embedding IS NULL AS INTEGER) AS title_emb_missing,
  round((t_us - (1672531200000000 + user_id * 3600000000)) / 8.64e10, 6) AS user_account_age,
  round((t_us - (1672531200000000 + streamer_id * 86400000000)) / 8.64e10, 6) AS streamer_account_age,
  CAST(NULL AS DOUBLE) AS streamer_live_age, round((t_us - start_us) / 1e3, 6) AS time_since_live_start
FROM base LEFT JOIN cu ON user_id = c_custkey LEFT JOIN su ON streamer_id = s_suppkey LEFT JOIN room USING (live_id)
LEFT JOIN best USING (live_id) LEFT JOIN ids USING (name) LEFT JOIN embeddings v ON v.vec_id = rid"""
}
