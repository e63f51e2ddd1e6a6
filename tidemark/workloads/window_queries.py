"""Queries W1-W25, O12, O13: each feature family over the whole event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY_US
from tidemark.operators import ranking
from tidemark.operators.rolling import Past, past_aggregates, rolling_distinct
from tidemark.operators.skew import group_sizes
from tidemark.plans.features import FAMILIES, build_features, family_columns, measure_keys
from tidemark.workloads import binding as b

NEEDS_LABELS = {"W8", "W9", "W10", "W15", "W16", "W17", "W21"}
NAMES = {
    "W1": "W1_ctr_user", "W2": "W2_imp_user", "W3": "W3_click_user", "W4": "W4_last_impression_user",
    "W5": "W5_last_click_user", "W6": "W6_skips_user", "W7": "W7_watch_user", "W8": "W8_comment_user",
    "W9": "W9_like_user", "W10": "W10_gift_user", "W11": "W11_ctr_room", "W12": "W12_imp_room",
    "W13": "W13_click_room", "W14": "W14_watch_room", "W15": "W15_comment_room", "W16": "W16_like_room",
    "W17": "W17_gift_room", "W18": "W18_volume_streamer", "W19": "W19_lives_streamer",
    "W20": "W20_watch_streamer", "W21": "W21_events_streamer", "W22": "W22_user_streamer",
    "W23": "W23_recency_user_streamer", "W24": "W24_user_category",
}


# Families whose sliced plan is also registered, with the rows from which a key counts as hot there:
# most keys of the given tables pass it, and are cut into several slices (W14: the largest into more than 50).
SLICED = {"W1": 4, "W6": 4, "W10": 4, "W14": 8, "W19": 150, "W20": 150, "W21": 150}


def family_query(family: str, hot_rows: int | None = None) -> Callable:
    def run(spark, sf) -> DataFrame:
        raw = b.impressions(spark, sf)
        sizes = measure_keys(raw, [family], hot_rows)
        base = b.interactions(spark, sf) if family in NEEDS_LABELS else raw
        strategy = "auto" if hot_rows is None else "expiry"
        return b.rounded(build_features(base, [family], sizes, strategy).select("event_id", *family_columns([family])))

    return run


def feature_build(spark, sf) -> DataFrame:
    """All families on the attributed log (the feature stage as one job)."""
    sizes = measure_keys(b.impressions(spark, sf))
    return b.rounded(build_features(b.interactions(spark, sf), sizes=sizes).select("event_id", *family_columns(FAMILIES)))


def _ranked(spark, sf, **options) -> DataFrame:
    order = [F.col("watch_live_time").desc(), F.col("live_id"), F.col("streamer_id"), F.col("event_id")]
    rows = ranking.rank_in_group(b.impressions(spark, sf), ["user_id"], order, **options)
    return rows.select("event_id", "user_id", F.col("rank").cast("int").alias("rank"))


def rank_in_group(spark, sf) -> DataFrame:
    """Place of every impression in its user's list, by watch time, then item keys."""
    return _ranked(spark, sf)


def rank_in_group_sliced(spark, sf) -> DataFrame:
    """W25 by ranges of 37 rows: most users of the given tables fill a part of one, some several."""
    return _ranked(spark, sf, sizes=group_sizes(b.impressions(spark, sf), ["user_id"], hot_rows=2)[0], range_rows=37)


def expiry_sums(spark, sf) -> DataFrame:
    """Weekly sums per streamer in linear time, hot keys split."""
    df = b.interactions(spark, sf).withColumn("_one", F.lit(1))
    width = 7 * DAY_US
    specs = [
        Past("imps", "_one", width),
        Past("clicks", "is_click", width),
        Past("gifts", "gift_price", width, amount=True),
    ]
    sizes = group_sizes(b.impressions(spark, sf), ["streamer_id"])[0]
    out = past_aggregates(df, ["streamer_id"], specs, sizes, strategy="expiry")
    return b.rounded(out.select("event_id", "imps", "clicks", "gifts"))


def expiry_distinct(spark, sf) -> DataFrame:
    """Users seen by a live within three days, in linear time."""
    df = b.impressions(spark, sf)
    sizes = group_sizes(df, ["live_id"])[0]
    return rolling_distinct(df, ["live_id"], "user_id", 3 * DAY_US, "users_3d", sizes).select("event_id", "users_3d")


QUERIES = {NAMES[f]: family_query(f) for f in FAMILIES}
QUERIES |= {f"{NAMES[f]}_sliced": family_query(f, rows) for f, rows in SLICED.items()}
QUERIES |= {
    "W25_rank_in_group": rank_in_group,
    "W25_rank_in_group_sliced": rank_in_group_sliced,
    "W_all_features": feature_build,
    "O12_expiry_sums": expiry_sums,
    "O13_expiry_distinct": expiry_distinct,
}

US = {
    "10min": 600000000, "15min": 900000000, "30min": 1800000000, "1hr": 3600000000, "2hr": 7200000000,
    "3hr": 10800000000, "12hr": 43200000000, "24h": 86400000000, "1d": 86400000000, "7d": 604800000000,
}


def _windows(key: str) -> str:
    rng = ", ".join(
        f"r{n} AS (PARTITION BY {key} ORDER BY t_us RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING)"
        for n, us in US.items()
    )
    return (
        f"WINDOW {rng}, past AS (PARTITION BY {key} ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), upto AS (PARTITION BY {key} ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND CURRENT ROW)"
    )


def _select(key: str, columns: dict[str, str], source: str = "imp") -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    return f"SELECT event_id, {body} FROM {source} {_windows(key)}"


def _r(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def _ctr(subject, windows, prefix="ctr"):
    return {
        f"{prefix}_{subject}_{w}": _r(f"coalesce(sum(is_click) OVER r{w} / nullif(count(*) OVER r{w}, 0)::DOUBLE, 0)")
        for w in windows
    }


def _imp(subject, windows):
    return {f"num_imp_{subject}_{w}": f"count(*) OVER r{w}" for w in windows}


def _sum(column, name, window):
    return {name: f"CAST(coalesce(sum({column}) OVER {window}, 0) AS BIGINT)"}


def _clk(subject, windows):
    out = {}
    for w in windows:
        out |= _sum("is_click", f"num_click_{subject}_{w}", f"r{w}")
    return out


def _miss(e):
    return f"CAST(({e}) IS NULL AS INTEGER)"


def _user_rate(event):
    return {
        f"{event}_rate_user": _r(
            f"CASE WHEN count(*) OVER past > 0 THEN (sum(is_{event}) OVER past + 1.0) / (sum(is_click) OVER past + 1.0) "
            "ELSE 0 END"
        ),
        **_sum(f"is_{event}", f"num_{event}_user_24h", "r24h"),
        f"has_{event}_user_24h": f"CAST(coalesce(sum(is_{event}) OVER r24h, 0) > 0 AS INTEGER)",
    }


def _room_event(event):
    out = _sum(f"is_{event}", f"num_{event}_live", "past")
    out[f"{event}_rate_live"] = _r(f"coalesce(sum(is_{event}) OVER past / nullif(count(*) OVER past, 0)::DOUBLE, 0)")
    rate = {}
    for w in ("15min", "1hr", "3hr"):
        out |= _sum(f"is_{event}", f"num_{event}_live_{w}", f"r{w}")
        rate[w] = f"(sum(is_{event}) OVER r{w} / nullif(count(*) OVER r{w}, 0)::DOUBLE)"
        out[f"{event}_rate_live_{w}"] = _r(f"coalesce({rate[w]}, 0)")
    out[f"{event}_trend_room"] = _r(f"coalesce(ln({rate['15min']} + 1e-6) - ln({rate['1hr']} + 1e-6), 0)")
    return out


def _gift_room():
    out = _room_event("gift")
    for w, s, suffix in (("past", "past", ""), ("r15min", "15min", "_15min"), ("r1hr", "1hr", "_1hr"), ("r3hr", "3hr", "_3hr")):
        out[f"amount_gift_live{suffix}"] = _r(f"coalesce(sum(gift_price) OVER {w}, 0)")
    a, h = "sum(gift_price) OVER r15min", "sum(gift_price) OVER r1hr"
    out["gift_trend_room"] = _r(f"coalesce(ln(ln(1 + {a}) + 1) - ln(ln(1 + {h}) + 1), 0)")
    return out


_LAST_CLICK = "max(CASE WHEN is_click = 1 THEN t_us END) OVER past"
_LAST_IMP = "lag(t_us) OVER (PARTITION BY {key} ORDER BY t_us, event_id)"


def _watch(name, window):
    return (
        {
            f"avg_watch_time_{name}": _r(
                f"coalesce(sum(CAST(round(w * 1e6) AS BIGINT)) OVER {window} / 1e6::DOUBLE / count(w) OVER {window}, 0)"
            ),
            f"median_watch_time_{name}": _r(f"coalesce(quantile_cont(w, 0.5) OVER {window}, 0)"),
        }
    )


def _cross(subject):
    return {**_imp(subject, ["7d"]), **_clk(subject, ["7d"]), **_ctr(subject, ["7d"])}


_PAIR = "user_id, streamer_id"
_CAT = "user_id, cat"
_GAP_S = f"(t_us - ({_LAST_CLICK})) / 1e6"
_SEEN_S = f"(t_us - ({_LAST_IMP.format(key=_PAIR)})) / 1e6"
_SEEN_MS = f"(t_us - ({_LAST_IMP.format(key='user_id')})) / 1e3"
_GAP_MS = f"(t_us - ({_LAST_CLICK})) / 1e3"
_CTR_ROOM = "coalesce(sum(is_click) OVER r{w} / nullif(count(*) OVER r{w}, 0)::DOUBLE, 0)"

SELECTS = {
    "W1": _select("user_id", _ctr("user", ["15min", "3hr", "1d", "7d"])),
    "W2": _select("user_id", _imp("user", ["10min", "30min", "2hr", "12hr", "1d", "7d"])),
    "W3": _select("user_id", {
        **_clk("user", ["15min", "3hr", "1d", "7d"]),
        "click_trend_user": _r("coalesce(ln(sum(is_click) OVER r15min + 1) - ln(sum(is_click) OVER r3hr + 1), 0)"),
    }),
    "W4": _select("user_id", {
        "time_since_last_impression_user": _r(f"coalesce({_SEEN_MS}, 604800000)"), "tsli_missing": _miss(_SEEN_MS)}),
    "W5": _select("user_id", {
        "time_since_last_click_user": _r(f"coalesce({_GAP_MS}, 2592000000)"), "tslc_missing": _miss(_GAP_MS)}),
    "W6": (
        "SELECT event_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY t_us, event_id) - 1 "
        "AS consecutive_skips_user FROM (SELECT *, sum(is_click) OVER (PARTITION BY user_id ORDER BY t_us, event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM imp)"
    ),
    "W7": _select("user_id", {
        **_watch("user", "past"),
        "pct_long_watch_user_30s": _r(
            "coalesce((count(*) FILTER (w >= 30) OVER past) / nullif(sum(is_click) OVER past, 0)::DOUBLE, 0)"),
        "avg_watch_time_user_missing": _miss("avg(w) OVER past"),
        "median_watch_time_user_missing": _miss("avg(w) OVER past"),
    }),
    "W8": _select("user_id", _user_rate("comment"), "inter"),
    "W9": _select("user_id", _user_rate("like"), "inter"),
    "W10": _select("user_id", {
        **_sum("is_gift", "num_gift_user_7d", "r7d"),
        "amount_gift_user_7d": _r("coalesce(sum(gift_price) OVER r7d, 0)"),
        "has_gift_user_7d": "CAST(coalesce(sum(is_gift) OVER r7d, 0) > 0 AS INTEGER)",
    }, "inter"),
    "W11": _select("live_id", _ctr("room", ["10min", "30min", "2hr", "12hr"])),
    "W12": _select("live_id", _imp("room", ["10min", "30min", "2hr", "12hr", "1d"])),
    "W13": _select("live_id", {
        **_clk("room", ["10min", "30min", "2hr", "12hr", "1d"]),
        "ctr_trend_room": _r(f"ln({_CTR_ROOM.format(w='10min')} + 1e-6) - ln({_CTR_ROOM.format(w='2hr')} + 1e-6)"),
    }),
    "W14": _select("live_id", {
        **_watch("live", "past"),
        **_watch("live_30min", "r30min"),
        "pct_long_watch_live_60s_30min": _r(
            "coalesce((count(*) FILTER (w >= 60000) OVER r30min) / nullif(count(w) OVER r30min, 0)::DOUBLE, 0)"),
        "watch_time_live_missing": _miss("avg(w) OVER past"),
        "watch_time_live_30min_missing": _miss("avg(w) OVER r30min"),
    }),
    "W15": _select("live_id", _room_event("comment"), "inter"),
    "W16": _select("live_id", _room_event("like"), "inter"),
    "W17": _select("live_id", _gift_room(), "inter"),
    "W18": _select("streamer_id", {
        **_imp("streamer", ["7d"]), **_clk("streamer", ["7d"]), **_ctr("streamer", ["1d", "7d"])}),
    "W19": _select("streamer_id", {"num_lives_streamer_7d": "count(DISTINCT live_id) OVER r7d"}),
    "W20": _select("streamer_id", {
        **_watch("streamer", "past"),
        "pct_long_watch_streamer_30s": _r(
            "coalesce((count(*) FILTER (w >= 30000) OVER past) / nullif(count(w) OVER past, 0)::DOUBLE, 0)"),
        "watch_time_streamer_missing": _miss("avg(w) OVER past"),
    }),
    "W21": _select("streamer_id", {
        **_sum("is_comment", "num_comment_streamer_7d", "r7d"),
        **_sum("is_like", "num_like_streamer_7d", "r7d"),
        "amount_gift_streamer_7d": _r("coalesce(sum(gift_price) OVER r7d, 0)"),
    }, "inter"),
    "W22": _select(_PAIR, _cross("user_streamer")),
    "W23": _select(_PAIR, {
        "time_since_last_impression_user_streamer": _r(f"coalesce({_SEEN_S}, 0)"),
        "time_since_last_click_user_streamer": _r(f"coalesce({_GAP_S}, 0)"),
        "tsli_user_streamer_missing": _miss(_SEEN_S),
        "tslc_user_streamer_missing": _miss(_GAP_S),
    }),
    "W24": _select(_CAT, {
        n: f"CASE WHEN cat IS NULL THEN 0 ELSE {e} END" for n, e in _cross("user_category").items()}),
}

SQL = {
    NAMES[f]: f"WITH {b.INTER if f in NEEDS_LABELS else b.IMP} {SELECTS[f]}" for f in FAMILIES
}
SQL["W_all_features"] = (
    f"WITH {b.INTER} SELECT * FROM "
    + " JOIN ".join(f"({SELECTS[f]}) q{f}" + (" USING (event_id)" if i else "") for i, f in enumerate(FAMILIES))
)
SQL.update({f"{NAMES[f]}_sliced": SQL[NAMES[f]] for f in SLICED})
SQL["W25_rank_in_group"] = (
    f"WITH {b.IMP} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY watch_live_time DESC, "
    "live_id, streamer_id, event_id) AS rank FROM imp"
)
SQL["W25_rank_in_group_sliced"] = SQL["W25_rank_in_group"]
SQL["O12_expiry_sums"] = f"WITH {b.INTER} " + _select("streamer_id", {
    "imps": "count(*) OVER r7d",
    **_sum("is_click", "clicks", "r7d"),
    "gifts": _r("coalesce(sum(gift_price) OVER r7d, 0)"),
}, "inter")
SQL["O13_expiry_distinct"] = (
    f"WITH {b.IMP} SELECT event_id, count(DISTINCT user_id) OVER (PARTITION BY live_id ORDER BY t_us RANGE BETWEEN "
    "259200000000 PRECEDING AND 1 PRECEDING) AS users_3d FROM imp"
)
