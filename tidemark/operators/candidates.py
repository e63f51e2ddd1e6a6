"""Rule-based candidate generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import allowed_or_unknown, clip, recent, to_number
from tidemark.operators.dedup import latest_row
from tidemark.operators.ranking import top_k
from tidemark.operators.scalers import fit_minmax, unit_range
from tidemark.session import materialise

# Weight and preparation of each score term.
SCORE_TERMS = {
    "num_click_room_1d": (0.45, "log"),
    "num_imp_room_1d": (0.10, "log"),
    "ctr_room_12hr": (0.25, "plain"),
    "ctr_room_2hr": (0.15, "plain"),
    "accu_play_cnt_le": (0.05, "plain"),
    "fans_user_num_le": (0.05, "plain"),
    "follow_user_num_le": (0.03, "plain"),
    "accu_live_cnt_le": (0.03, "plain"),
    "accu_play_duration_le": (0.03, "plain"),
    "time_since_live_start": (0.08, "age"),
}
# Feature columns that the pair rules compare, and their names there.
USER_RULES = {
    "user_country_le": "country", "user_age_le": "age", "user_device_brand_le": "brand", "user_device_price_le": "price",
}
ITEM_RULES = {
    "streamer_country_le": "country", "streamer_age_le": "age", "streamer_device_brand_le": "brand",
    "streamer_device_price_le": "price",
}
MISSING_TITLE_PENALTY = 0.05
ANY = "any"
UNKNOWN = "unknown"


def _term(column: str, kind: str) -> Column:
    value = to_number(column, "double", 0.0)
    if kind == "plain":
        return value
    value = clip(value, 0.0)
    return F.log1p(value) if kind == "log" else value


def item_score(items: DataFrame, name: str = "rule_score") -> DataFrame:
    """Weighted sum of min-max columns; absent columns drop their term."""
    terms = {c: _term(c, kind) for c, (_, kind) in SCORE_TERMS.items() if c in items.columns}
    bounds = fit_minmax(items, terms) if terms else {}
    score = F.lit(0.0)
    for c, value in terms.items():
        weight, kind = SCORE_TERMS[c]
        unit = unit_range(value, bounds[c])
        score = score + F.lit(weight) * (F.lit(1.0) - unit if kind == "age" else unit)
    if "title_emb_missing" in items.columns:
        score = score - F.lit(MISSING_TITLE_PENALTY) * clip(to_number("title_emb_missing", "double", 0.0), 0.0, 1.0)
    return items.withColumn(name, score)


def user_profiles(features: DataFrame, time_us: str = "t_us", row_id: str = "event_id") -> DataFrame:
    """One row per user with the rule columns of its latest feature row."""
    rules = {c: n for c, n in USER_RULES.items() if c in features.columns}
    narrow = features.select("user_id", *[F.col(c).alias(n) for c, n in rules.items()], time_us, row_id)
    return latest_row(narrow, ["user_id"], time_us, row_id).drop(time_us, row_id)


def item_profiles(features: DataFrame, time_us: str = "t_us", row_id: str = "event_id") -> DataFrame:
    """One row per live with the rule and score columns of its latest feature row."""
    rules = {c: n for c, n in ITEM_RULES.items() if c in features.columns}
    kept = [c for c in (*SCORE_TERMS, "title_emb_missing", "live_type", "live_start_date") if c in features.columns]
    narrow = features.select("live_id", "streamer_id", *[F.col(c).alias(n) for c, n in rules.items()], *kept, time_us, row_id)
    return latest_row(narrow, ["live_id"], time_us, row_id).drop(time_us, row_id)


def global_item_rules(
    items: DataFrame, reference_date: str, max_age_days: int = 14, types: tuple = (1, 2, 3)
) -> DataFrame:
    """Recent lives of an expected or unknown type."""
    out = items
    if "live_start_date" in out.columns:
        out = out.where(recent("live_start_date", reference_date, max_age_days))
    if "live_type" in out.columns:
        out = out.where(allowed_or_unknown("live_type", types))
    return out


def _exact_keys(user: Column, item: Column) -> tuple[Column, Column]:
    """Key lists whose equality means: item unknown, user unknown, or both equal."""
    user_keys = F.when(user.isNull(), F.array(F.lit(ANY))).otherwise(
        F.array(user.cast("string"), F.lit(UNKNOWN))
    )
    item_keys = F.array(F.lit(ANY), F.coalesce(item.cast("string"), F.lit(UNKNOWN)))
    return user_keys, item_keys


def _gap_keys(user: Column, item: Column, gap: int) -> tuple[Column, Column]:
    """Key lists whose equality holds wherever ``|user - item| <= gap`` may hold, or one of them is unknown.

    Values fall into buckets as wide as the gap; an item is in its own bucket and both neighbours.
    """
    width = max(gap, 1)
    bucket = lambda x: F.floor(x / F.lit(float(width)))
    near = [(bucket(item) + d).cast("string") for d in (-1, 0, 1)]
    user_keys = F.when(user.isNull(), F.array(F.lit(ANY))).otherwise(
        F.array(bucket(user).cast("string"), F.lit(UNKNOWN))
    )
    item_keys = F.when(item.isNull(), F.array(F.lit(ANY), F.lit(UNKNOWN))).otherwise(F.array(F.lit(ANY), *near))
    return user_keys, item_keys


def rule_candidates(
    users: DataFrame,
    items: DataFrame,
    k: int = 300,
    allow_cross_country: bool = False,
    max_age_gap: int = 3,
    strict_brand: bool = False,
    max_price_gap: int = 3,
) -> DataFrame:
    """Top-K items per user under the pair rules (J5, T3), ties by item keys.

    ``users`` has user_id, country, age, brand, price; ``items`` live_id,
    streamer_id, rule_score and the same attributes.  The rules only look at
    the attributes, so work is done per attribute profile:

    1. of each item profile only the best items can be chosen.  A user skips
       its own lives, at most K of which are ahead of its K answers, so the
       best 2K items with at most K per streamer are enough;
    2. user profiles meet item profiles by equality on a key of every active
       rule (the value, or a bucket for gaps, with the gap as a residual), and
       keep the best 2K the same way; without an active rule there is one
       profile on either side;
    3. users join their profile's list, drop their own lives and keep K.

    No user-item pair is built beyond 2K per user.
    """
    active = {
        "country": not allow_cross_country, "age": max_age_gap >= 0, "brand": strict_brand, "price": max_price_gap >= 0
    }
    sides = [s for s, used in active.items() if used]
    users = users.select("user_id", *[to_number(s, "double").alias(s) for s in sides])
    items = items.select("live_id", "streamer_id", "rule_score", *[to_number(s, "double").alias(s) for s in sides])
    best_first = [F.col("rule_score").desc(), "live_id", "streamer_id"]

    def shortlist(df: DataFrame, group: list[str]) -> DataFrame:
        return top_k(top_k(df, [*group, "streamer_id"], best_first, k, None), group, best_first, 2 * k, None)

    # Attributes no active rule looks at do not split a profile.
    profile = F.concat_ws("|", F.lit(""), *[F.coalesce(F.col(s).cast("string"), F.lit("-")) for s in sides])
    # Read for the profiles and for the lists.
    kept = materialise(shortlist(items.withColumn("_ip", profile), ["_ip"]))
    item_profiles = kept.select("_ip", *[F.col(s).alias(f"i_{s}") for s in sides]).distinct()
    users = users.withColumn("_up", profile)
    user_profiles = users.select("_up", *[F.col(s).alias(f"u_{s}") for s in sides]).distinct()

    left, right = user_profiles, item_profiles
    gaps = {"age": max_age_gap, "price": max_price_gap}
    for side in sides:
        u, i = F.col(f"u_{side}"), F.col(f"i_{side}")
        user_keys, item_keys = _gap_keys(u, i, gaps[side]) if side in gaps else _exact_keys(u, i)
        left = left.withColumn(f"_{side}", F.explode(user_keys))
        right = right.withColumn(f"_{side}", F.explode(item_keys))
    if not sides:
        left, right = left.withColumn("_one", F.lit(0)), right.withColumn("_one", F.lit(0))

    def near(side: str, gap: int) -> Column:
        if not active[side]:
            return F.lit(True)
        u, i = F.col(f"u_{side}"), F.col(f"i_{side}")
        return u.isNull() | i.isNull() | (F.abs(u - i) <= gap)

    matches = left.join(right, [f"_{s}" for s in sides] or ["_one"]).where(near("age", max_age_gap) & near("price", max_price_gap))
    # Few profile pairs grow into many list rows: keep the full parallelism where AQE would merge partitions.
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = shortlist(
        matches.select("_up", "_ip").repartition(parts, "_up").join(kept.select("_ip", "live_id", "streamer_id", "rule_score"), "_ip"), ["_up"]
    )
    offered = users.select("user_id", "_up").join(
        lists.select("_up", "live_id", "streamer_id", "rule_score"), "_up"
    )
    mine = offered.where(F.col("streamer_id") != F.col("user_id"))
    return top_k(mine, ["user_id"], best_first, k).select("user_id", "live_id", "streamer_id", "rank", "rule_score")


def mark_positives(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """``is_positive`` on candidates, 0 where the pair was never labelled."""
    labels = pairs.groupBy("user_id", "live_id").agg(F.max("is_positive").alias("_p"))
    joined = candidates.join(labels, ["user_id", "live_id"], "left")
    return joined.select(*candidates.columns, F.coalesce("_p", F.lit(0)).alias("is_positive"))


def candidate_lists(candidates: DataFrame, k: int) -> DataFrame:
    """Per user: number of distinct items and the ids in rank order (A11); at most ``k`` rows per user are collected."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "live_id"))), lambda s: s["live_id"].cast("string")
    )
    return (
        candidates.where(F.col("rank") <= k)
        .groupBy("user_id")
        .agg(
            F.count_distinct("live_id").alias("candidate_count"),
            F.array_join(ordered, "|").alias("item_list"),
        )
    )
