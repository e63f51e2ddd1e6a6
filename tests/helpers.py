"""Small frames and plain-Python references for the operators."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

DAY = 86_400_000_000
MIN = 60_000_000


def log_rows(n=400, users=6, lives=5, seed=3, hot_share=0.4, step=7 * MIN):
    """Impressions where one user, live and streamer hold a large share; some times repeat."""
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        if rng.random() > 0.15:
            t += rng.randrange(0, 2 * step)
        hot = rng.random() < hot_share
        live = 0 if hot else rng.randrange(lives)
        click = int(rng.random() < 0.55)
        rows.append(
            dict(
                event_id=i, user_id=0 if hot else rng.randrange(users), live_id=live, streamer_id=live % 2, t_us=t,
                is_click=click, watch_live_time=round(rng.random() * 90, 1) if click else 0.0,
                is_like=int(rng.random() < 0.2) * click, is_comment=int(rng.random() < 0.2) * click,
                is_gift=int(rng.random() < 0.1) * click, gift_price=round(rng.random() * 5, 2) if click else 0.0,
                live_content_category_le=None if live == 4 else live % 3,
            )
        )
    return rows


SCHEMA = (
    "event_id bigint, user_id bigint, live_id bigint, streamer_id bigint, t_us bigint, is_click int, "
    "watch_live_time double, is_like int, is_comment int, is_gift int, gift_price double, live_content_category_le int"
)


def frame(spark, rows, schema=SCHEMA):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def past(rows, r, key, window):
    return [x for x in rows if x[key] == r[key] and r["t_us"] - window <= x["t_us"] < r["t_us"]]


def earlier(rows, r, key):
    return [x for x in rows if x[key] == r[key] and (x["t_us"], x["event_id"]) < (r["t_us"], r["event_id"])]


def watch_median(rows):
    values = [x["watch_live_time"] for x in rows if x["is_click"]]
    return statistics.median(values) if values else 0.0


def by_id(df, key="event_id"):
    return {r[key]: r for r in df.collect()}

