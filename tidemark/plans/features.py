"""The 24 past-only feature families (W1-W24), declared once and expanded into one stage per key.

A family is a function of an ``Ask``: it names the past aggregates it needs
and returns its output columns.  All families of one key share their windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    DAY_US,
    HOUR_US,
    MINUTE_US,
    elapsed,
    fill,
    log_contrast,
    missing_flag,
    ratio,
    smoothed_rate,
    start_bucket,
)
from tidemark.operators.medians import past_medians
from tidemark.operators.rolling import (
    ROW,
    TIME,
    Past,
    past_aggregates,
    past_last_time,
    rolling_distinct,
    skips_since,
)
from tidemark.operators.skew import SLIDING_ROWS, GroupSizes, group_sizes
from tidemark.session import materialise, materialise_by

WINDOWS = {
    "10min": 10 * MINUTE_US, "15min": 15 * MINUTE_US, "30min": 30 * MINUTE_US,
    "1hr": HOUR_US, "2hr": 2 * HOUR_US, "3hr": 3 * HOUR_US, "12hr": 12 * HOUR_US,
    "24h": DAY_US, "1d": DAY_US, "7d": 7 * DAY_US, "all": None,
}
KEYS = {
    "user": ["user_id"],
    "user_streamer": ["user_id", "streamer_id"],
    "user_category": ["user_id", "live_content_category_le"],
    "room": ["live_id"],
    "streamer": ["streamer_id"],
}
AMOUNTS = {"gift_price", "_watch"}
LONG_WATCH = {"user": 30.0, "room": 60000.0, "streamer": 30000.0}
FIRST_IMPRESSION_MS = 7 * 24 * 3600 * 1000
FIRST_CLICK_MS = 30 * 24 * 3600 * 1000


@dataclass
class Ask:
    """Collects what the families of one key need."""

    key: str
    past: dict[str, Past] = field(default_factory=dict)
    last: set[str] = field(default_factory=set)
    medians: dict[str, int | None] = field(default_factory=dict)
    distinct: dict[str, tuple[str, int]] = field(default_factory=dict)
    skips: bool = False

    def sum(self, measure: str, window: str) -> Column:
        width = WINDOWS[window]
        name = f"_{measure.strip('_')}_{width or 'all'}"
        self.past[name] = Past(name, measure, width, amount=measure in AMOUNTS)
        return F.col(name)

    def last_time(self, what: str) -> Column:
        self.last.add(what)
        return F.col(f"_last_{what}")

    def median(self, window: str) -> Column:
        name = f"_median_{window}"
        self.medians[name] = WINDOWS[window]
        return F.col(name)

    def unique(self, value: str, window: str) -> Column:
        name = f"_unique_{value}_{window}"
        self.distinct[name] = (value, WINDOWS[window])
        return F.col(name)

    def rows_since_click(self) -> Column:
        self.skips = True
        return F.col("_skips")


Family = Callable[[Ask], dict[str, Column]]


def _flag(count: Column) -> Column:
    return (count > 0).cast("int")


def _ctr(subject: str, windows: Iterable[str]) -> Family:
    return lambda a: {f"ctr_{subject}_{w}": ratio(a.sum("is_click", w), a.sum("_one", w)) for w in windows}


def _impressions(subject: str, windows: Iterable[str]) -> Family:
    return lambda a: {f"num_imp_{subject}_{w}": a.sum("_one", w) for w in windows}


def _clicks(subject: str, windows: Iterable[str]) -> Family:
    return lambda a: {f"num_click_{subject}_{w}": a.sum("is_click", w) for w in windows}


def user_clicks(a: Ask) -> dict[str, Column]:
    out = _clicks("user", ["15min", "3hr", "1d", "7d"])(a)
    trend = log_contrast(out["num_click_user_15min"], out["num_click_user_3hr"], 1.0)
    return {**out, "click_trend_user": F.when(a.sum("_one", "15min") > 0, trend).otherwise(F.lit(0.0))}


def user_recency(a: Ask) -> dict[str, Column]:
    since = elapsed(TIME, a.last_time("impression"), "ms")
    return {
        "time_since_last_impression_user": fill(since, float(FIRST_IMPRESSION_MS)),
        "tsli_missing": missing_flag(since),
    }


def user_click_recency(a: Ask) -> dict[str, Column]:
    since = elapsed(TIME, a.last_time("click"), "ms")
    return {"time_since_last_click_user": fill(since, float(FIRST_CLICK_MS)), "tslc_missing": missing_flag(since)}


def user_skips(a: Ask) -> dict[str, Column]:
    return {"consecutive_skips_user": a.rows_since_click()}


def _watch(a: Ask, window: str) -> tuple[Column, Column, Column]:
    watched = a.sum("_watched", window)
    return watched, F.try_divide(a.sum("_watch", window), watched), a.median(window)


def user_watch(a: Ask) -> dict[str, Column]:
    _, mean, median = _watch(a, "all")
    return {
        "avg_watch_time_user": fill(mean, 0.0),
        "median_watch_time_user": fill(median, 0.0),
        "pct_long_watch_user_30s": ratio(a.sum("_long_user", "all"), a.sum("is_click", "all")),
        "avg_watch_time_user_missing": missing_flag(mean),
        "median_watch_time_user_missing": missing_flag(median),
    }


def _user_rate(event: str) -> Family:
    def family(a: Ask) -> dict[str, Column]:
        rate = smoothed_rate(a.sum(f"is_{event}", "all"), a.sum("is_click", "all"))
        recent = a.sum(f"is_{event}", "24h")
        return {
            f"{event}_rate_user": F.when(a.sum("_one", "all") > 0, rate).otherwise(F.lit(0.0)),
            f"num_{event}_user_24h": recent,
            f"has_{event}_user_24h": _flag(recent),
        }

    return family


def user_gifts(a: Ask) -> dict[str, Column]:
    gifts = a.sum("is_gift", "7d")
    return {
        "num_gift_user_7d": gifts,
        "amount_gift_user_7d": a.sum("gift_price", "7d"),
        "has_gift_user_7d": _flag(gifts),
    }


def room_clicks(a: Ask) -> dict[str, Column]:
    out = _clicks("room", ["10min", "30min", "2hr", "12hr", "1d"])(a)
    short, long = (ratio(a.sum("is_click", w), a.sum("_one", w)) for w in ("10min", "2hr"))
    return {**out, "ctr_trend_room": log_contrast(short, long, 1e-6)}


def room_watch(a: Ask) -> dict[str, Column]:
    _, mean, median = _watch(a, "all")
    watched, mean_30, median_30 = _watch(a, "30min")
    return {
        "avg_watch_time_live": fill(mean, 0.0),
        "median_watch_time_live": fill(median, 0.0),
        "avg_watch_time_live_30min": fill(mean_30, 0.0),
        "median_watch_time_live_30min": fill(median_30, 0.0),
        "pct_long_watch_live_60s_30min": ratio(a.sum("_long_room", "30min"), watched),
        "watch_time_live_missing": (mean.isNull() | median.isNull()).cast("int"),
        "watch_time_live_30min_missing": (mean_30.isNull() | median_30.isNull()).cast("int"),
    }


def _room_events(event: str) -> Family:
    def family(a: Ask) -> dict[str, Column]:
        out = {
            f"num_{event}_live": a.sum(f"is_{event}", "all"),
            f"{event}_rate_live": ratio(a.sum(f"is_{event}", "all"), a.sum("_one", "all")),
        }
        rates = {}
        for w in ("15min", "1hr", "3hr"):
            out[f"num_{event}_live_{w}"] = a.sum(f"is_{event}", w)
            rates[w] = F.try_divide(a.sum(f"is_{event}", w).cast("double"), a.sum("_one", w).cast("double"))
            out[f"{event}_rate_live_{w}"] = fill(rates[w], 0.0)
        out[f"{event}_trend_room"] = fill(log_contrast(rates["15min"], rates["1hr"], 1e-6), 0.0)
        return out

    return family


def room_gifts(a: Ask) -> dict[str, Column]:
    out = _room_events("gift")(a)
    for w, suffix in (("all", ""), ("15min", "_15min"), ("1hr", "_1hr"), ("3hr", "_3hr")):
        out[f"amount_gift_live{suffix}"] = a.sum("gift_price", w)
    short, long = (F.log1p(a.sum("gift_price", w)) for w in ("15min", "1hr"))
    trend = log_contrast(short, long, 1.0)
    out["gift_trend_room"] = F.when(a.sum("_one", "15min") > 0, trend).otherwise(F.lit(0.0))
    return out


def streamer_volume(a: Ask) -> dict[str, Column]:
    return {
        **_impressions("streamer", ["7d"])(a),
        **_clicks("streamer", ["7d"])(a),
        **_ctr("streamer", ["1d", "7d"])(a),
    }


def streamer_lives(a: Ask) -> dict[str, Column]:
    return {"num_lives_streamer_7d": a.unique("live_id", "7d")}


def streamer_watch(a: Ask) -> dict[str, Column]:
    watched, mean, median = _watch(a, "all")
    return {
        "avg_watch_time_streamer": fill(mean, 0.0),
        "median_watch_time_streamer": fill(median, 0.0),
        "pct_long_watch_streamer_30s": ratio(a.sum("_long_streamer", "all"), watched),
        "watch_time_streamer_missing": (mean.isNull() | median.isNull()).cast("int"),
    }


def streamer_events(a: Ask) -> dict[str, Column]:
    return {
        "num_comment_streamer_7d": a.sum("is_comment", "7d"),
        "num_like_streamer_7d": a.sum("is_like", "7d"),
        "amount_gift_streamer_7d": a.sum("gift_price", "7d"),
    }


def _cross(subject: str) -> Family:
    return lambda a: {
        **_impressions(subject, ["7d"])(a),
        **_clicks(subject, ["7d"])(a),
        **_ctr(subject, ["7d"])(a),
    }


def pair_recency(a: Ask) -> dict[str, Column]:
    seen = elapsed(TIME, a.last_time("impression"), "s")
    clicked = elapsed(TIME, a.last_time("click"), "s")
    return {
        "time_since_last_impression_user_streamer": fill(seen, 0.0),
        "time_since_last_click_user_streamer": fill(clicked, 0.0),
        "tsli_user_streamer_missing": missing_flag(seen),
        "tslc_user_streamer_missing": missing_flag(clicked),
    }


def category_volume(a: Ask) -> dict[str, Column]:
    unknown = F.col("live_content_category_le").isNull()
    out = _cross("user_category")(a)
    return {name: F.when(unknown, F.lit(0)).otherwise(value) for name, value in out.items()}


FAMILIES: dict[str, tuple[str, Family]] = {
    "W1": ("user", _ctr("user", ["15min", "3hr", "1d", "7d"])),
    "W2": ("user", _impressions("user", ["10min", "30min", "2hr", "12hr", "1d", "7d"])),
    "W3": ("user", user_clicks),
    "W4": ("user", user_recency),
    "W5": ("user", user_click_recency),
    "W6": ("user", user_skips),
    "W7": ("user", user_watch),
    "W8": ("user", _user_rate("comment")),
    "W9": ("user", _user_rate("like")),
    "W10": ("user", user_gifts),
    "W22": ("user_streamer", _cross("user_streamer")),
    "W23": ("user_streamer", pair_recency),
    "W24": ("user_category", category_volume),
    "W11": ("room", _ctr("room", ["10min", "30min", "2hr", "12hr"])),
    "W12": ("room", _impressions("room", ["10min", "30min", "2hr", "12hr", "1d"])),
    "W13": ("room", room_clicks),
    "W14": ("room", room_watch),
    "W15": ("room", _room_events("comment")),
    "W16": ("room", _room_events("like")),
    "W17": ("room", room_gifts),
    "W18": ("streamer", streamer_volume),
    "W19": ("streamer", streamer_lives),
    "W20": ("streamer", streamer_watch),
    "W21": ("streamer", streamer_events),
}


def family_columns(ids: Iterable[str]) -> list[str]:
    return [name for i in ids for name in FAMILIES[i][1](Ask(FAMILIES[i][0]))]


def _prepare(df: DataFrame) -> DataFrame:
    """Helper measures: watch time counts only on clicks."""
    watch = F.when(F.col("is_click") == 1, F.col("watch_live_time"))
    return df.withColumns(
        {
            "_one": F.lit(1),
            "_watch": watch,
            "_watched": watch.isNotNull().cast("int"),
            **{f"_long_{k}": F.coalesce((watch >= v).cast("int"), F.lit(0)) for k, v in LONG_WATCH.items()},
        }
    )


def measure_keys(impressions: DataFrame, ids: Iterable[str] = tuple(FAMILIES), hot_rows: int | None = None):
    """Group sizes of every key the families use, from one narrow pass over the raw impressions."""
    keys = list(dict.fromkeys(FAMILIES[i][0] for i in ids))
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    return dict(zip(keys, group_sizes(impressions, *[KEYS[k] for k in keys], **options)))


def build_features(
    df: DataFrame,
    ids: Iterable[str] = tuple(FAMILIES),
    sizes: dict[str, GroupSizes] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Adds the columns of the named families to an interaction table.

    ``df`` has ``event_id``, integer ``t_us``, the keys of the families and
    the label columns they count.
    """
    ids = list(ids)
    sizes = sizes or measure_keys(df, ids)
    keys = [k for k in KEYS if any(FAMILIES[i][0] == k for i in ids)]
    heavy = strategy == "expiry" or any(s.hot is not None or s.largest > SLIDING_ROWS for s in sizes.values())
    prepared = _prepare(df)
    if not heavy:
        out, made = prepared, []
        for key in keys:
            out, columns = _key_features(out, out, key, ids, sizes[key], strategy)
            out = out.select(*prepared.columns, *made, *[c.alias(n) for n, c in columns.items()])
            made += list(columns)
        return out.select(*df.columns, *made)
    # The split plans read the narrow interaction table several times per key, and are long: each key's features are
    # stored on their own, by row number, and all meet at the end where they lie.
    source = materialise(prepared.withColumn(_NUMBER, F.monotonically_increasing_id()))
    out, made = materialise_by(source.select(_NUMBER, *df.columns), _NUMBER) if len(keys) > 1 else None, []
    for key in keys:
        rows, columns = _key_features(source, source, key, ids, sizes[key], strategy)
        if out is None:
            return rows.select(*df.columns, *[c.alias(n) for n, c in columns.items()])
        part = materialise_by(rows.select(_NUMBER, *[c.alias(n) for n, c in columns.items()]), _NUMBER)
        out, made = out.join(part, _NUMBER), made + list(columns)
    return df.select(*df.columns) if out is None else out.select(*df.columns, *made)


#: Number of a stored row.
_NUMBER = "_number"


def _key_features(
    out: DataFrame, source: DataFrame, key: str, ids: Sequence[str], size: GroupSizes, strategy: str
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with all measures that the families of one key need, and the features made of them."""
    ask, columns, by = Ask(key), {}, KEYS[key]
    for i in ids:
        if FAMILIES[i][0] == key:
            columns.update(FAMILIES[i][1](ask))
    conditions = {"impression": F.lit(True), "click": F.col("is_click") == 1}
    if ask.last:
        out = past_last_time(out, by, {f"_last_{w}": conditions[w] for w in sorted(ask.last)}, size, source)
    if ask.skips:
        out = skips_since(out, by, "is_click", "_skips", size, source)
    # Row frames come first: their sort order also serves the range frames.
    if ask.past:
        out = past_aggregates(out, by, list(ask.past.values()), size, strategy, source)
    for name, (value, width) in ask.distinct.items():
        out = rolling_distinct(out, by, value, width, name, size, source)
    if ask.medians and _NUMBER in out.columns:  # only what the solver reads goes through it, and meets the rows by number
        narrow = source.select(_NUMBER, *by, TIME, ROW, "_watch")
        found = past_medians(narrow, by, "_watch", ask.medians, size, source=source).select(_NUMBER, *ask.medians)
        out = out.join(found, _NUMBER)
    elif ask.medians:
        out = past_medians(out, by, "_watch", ask.medians, size, source=source)
    return out, columns


def context_features(df: DataFrame) -> DataFrame:
    """Ages and time since the live started (P8, P9); inputs are integer microsecond columns."""
    wanted = {
        "user_account_age": ("user_reg_us", "day"),
        "user_watch_live_age": ("first_watch_live_us", "day"),
        "time_since_live_start": ("start_us", "ms"),
        "time_since_start_live": ("start_us", "ms"),
        "streamer_account_age": ("streamer_reg_us", "day"),
        "streamer_live_age": ("first_live_us", "day"),
    }
    out = df.withColumns({n: elapsed(TIME, c, unit) for n, (c, unit) in wanted.items() if c in df.columns})
    if "time_since_start_live" in out.columns:
        out = out.withColumn("time_since_start_live_bucket", start_bucket("time_since_start_live"))
    return out
