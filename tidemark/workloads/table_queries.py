"""Queries J1-J11, A1-A18, E1-E10, U1-U6: joins, encoders, scalers, de-duplication, profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import dedup, encoders, profiling, scalers
from tidemark.operators.attribution import attribute_followups, timeline
from tidemark.operators.dimensions import aligned_vectors, attach_vectors, merge_dimensions
from tidemark.operators.metrics import missing_examples, overlap_report, shared_keys
from tidemark.operators.ranking import top_k
from tidemark.operators.skew import group_sizes
from tidemark.operators.retrieval import item_pool, pool_positions
from tidemark.plans.evaluation import join_labels, rank_candidates
from tidemark.plans.scaling import scale_features
from tidemark.plans.splits import ranking_splits, retrieval_splits, with_split
from tidemark.plans.features import build_features, measure_keys
from tidemark.workloads import binding as b
from tidemark.workloads.scalar_queries import STARTED, scored_impressions, started


def _attributed(spark, sf, *columns):
    ev = b.events(spark, sf)
    return attribute_followups(b.clicks(ev), b.followups(ev)).select("event_id", *columns)


def likes(spark, sf):
    return _attributed(spark, sf, "latest_like_us", "is_like")


def comments(spark, sf):
    return _attributed(spark, sf, "latest_comment_us", "is_comment")


def gifts(spark, sf):
    return b.rounded(_attributed(spark, sf, "latest_gift_us", "is_gift", "gift_price"))


def gifts_sliced(spark, sf):
    """J1c with keys of four rows on cut into slices."""
    ev = b.events(spark, sf)
    keys = ["user_id", "live_id", "streamer_id"]
    sizes = group_sizes(ev.where(F.col("event_type") != "view").select(*keys), keys, hot_rows=4)[0]
    out = attribute_followups(b.clicks(ev), b.followups(ev), sizes=sizes)
    return b.rounded(out.select("event_id", "latest_gift_us", "is_gift", "gift_price"))


def interactions(spark, sf):
    return b.rounded(b.interactions(spark, sf).drop("imp_timestamp", "live_content_category_le"))


def event_timeline(spark, sf):
    ev = b.events(spark, sf)
    return timeline(b.clicks(ev), b.followups(ev))


def _dims(spark, sf):
    user = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("user_country"), "c_acctbal")
    streamer = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("streamer_id"), F.col("s_nationkey").alias("streamer_country"))
    lines = b.order_lines(spark, sf).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("live_id"), F.col("l_suppkey").alias("streamer_id"),
        "l_orderkey", "l_quantity", "l_shipdate", "l_returnflag",
    )
    rooms = lines.select("live_id", "streamer_id").distinct().join(
        b.table(spark, sf, "part").select(F.col("p_partkey").alias("live_id"), "p_size", "p_brand"), "live_id"
    )
    return lines, user, rooms, streamer


def dimension_join(spark, sf):
    lines, user, rooms, streamer = _dims(spark, sf)
    return merge_dimensions(lines.drop("l_shipdate", "l_returnflag"), user, rooms, streamer)


def vector_join(spark, sf):
    e = b.events(spark, sf).select("event_id", F.when(F.col("live_id") == 3, -1).otherwise(F.col("live_id")).alias("live_name_id"))
    vectors = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    # Only titles of real events own a vector; the unnamed ones (-1) get zeros.
    placed = aligned_vectors(e, "live_name_id", vectors)
    out = attach_vectors(e, "live_name_id", placed, 64)
    total = F.aggregate("title_emb", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return b.rounded(out.select("event_id", "live_name_id", "title_emb_missing", total.alias("total")))


def handoff(spark, sf):
    imp = b.impressions(spark, sf)
    pairs = imp.select("user_id", "live_id", "streamer_id", F.col("event_id").alias("e"))
    seen = dedup.first_row(pairs, ["user_id", "live_id", "streamer_id"], "e")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("e"))
    listed = seen.withColumn("rank", place)
    topk = listed.select("user_id", "live_id", "streamer_id", "rank", (F.col("e") / 7.0).alias("score"))
    out = rank_candidates(topk, imp, 10)
    return b.rounded(out.select("user_id", "live_id", "streamer_id", "stage1_rank", "stage1_score", "event_id", "is_click"))


def label_join(spark, sf):
    s = scored_impressions(spark, sf, labels=True)
    scored = dedup.first_row(s, ["user_id", "live_id", "streamer_id"], "event_id").select("user_id", "live_id", "streamer_id", "score_ctr")
    out = join_labels(scored, s, ["live_content_category_le"])
    return b.rounded(out)


def anti_join(spark, sf):
    return dedup.unclicked_candidates(b.impressions(spark, sf)).select("event_id")


def _split_pairs(spark, sf):
    rows = with_split(b.impressions(spark, sf), dates=b.SPLIT)
    return rows.where(F.col("split") == "test"), rows.where(F.col("split") == "train")


def indicator(spark, sf):
    test, train = _split_pairs(spark, sf)
    return missing_examples(test, train, ["user_id", "live_id", "streamer_id"])


def overlap(spark, sf):
    test, train = _split_pairs(spark, sf)
    return b.rounded(overlap_report(test, train))


def shared(spark, sf):
    test, train = _split_pairs(spark, sf)
    return shared_keys(test, train, ["user_id", "live_id", "streamer_id"])


def pool_index(spark, sf):
    imp = b.impressions(spark, sf)
    clicked = item_pool(imp.where(F.col("is_click") == 1))
    return pool_positions(imp.select("event_id", "live_id", "streamer_id"), clicked)


def hits(spark, sf):
    imp = b.impressions(spark, sf)
    pairs = ["user_id", "live_id", "streamer_id"]
    gt = imp.where(F.col("is_click") == 1).select(*pairs).distinct()
    seen = imp.where(F.col("is_click") == 0).select(*pairs).distinct()
    return gt.join(seen, pairs, "left_semi")


def positives(spark, sf):
    return dedup.positive_pairs(b.impressions(spark, sf))


def frequent(spark, sf):
    return dedup.most_frequent(b.events(spark, sf), "user_id", "live_id", "t_us")


def latest(spark, sf):
    return dedup.latest_row(b.impressions(spark, sf), ["user_id", "live_id", "streamer_id"], "t_us", "event_id").select(
        "event_id", "user_id", "live_id", "streamer_id", "is_click"
    )


def click_priority(spark, sf):
    return dedup.click_priority(b.impressions(spark, sf)).select("event_id", "user_id", "live_id", "streamer_id", "is_click")


def first(spark, sf):
    return dedup.first_row(b.impressions(spark, sf), ["user_id"], "t_us", "event_id").select("user_id", "event_id", "t_us")


def unique(spark, sf):
    return profiling.unique_counts(b.events(spark, sf), ["user_id", "live_id", "streamer_id"])


def unique_by_user(spark, sf):
    return profiling.unique_per_user(b.impressions(spark, sf), "live_id")


def quantiles(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    wanted = {x: (F.col(x), [0.01, 0.25, 0.5, 0.99]) for x in ("l_quantity", "l_extendedprice")}
    found = scalers.exact_quantiles(lines, wanted)
    stats = lines.agg(
        *[f(x).alias(f"{x}_{n}") for x in wanted for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    return b.rounded(
        stats.select("*", *[F.lit(v).alias(f"{x}_q{int(q * 100):02d}") for x, (_, qs) in wanted.items() for q, v in zip(qs, found[x])])
    )


def quantiles_bracketed(spark, sf):
    """A7 with few parts for each bracket, so that many passes are taken."""
    lines = b.table(spark, sf, "lineitem")
    wanted = {x: (F.col(x), [0.01, 0.25, 0.5, 0.99]) for x in ("l_quantity", "l_extendedprice")}
    found = scalers.exact_quantiles(lines, wanted, bins=6)
    one = lines.agg(F.count(F.lit(1)).alias("rows"))
    return b.rounded(
        one.select("rows", *[F.lit(v).alias(f"{x}_q{int(q * 100):02d}") for x, (_, qs) in wanted.items() for q, v in zip(qs, found[x])])
    )


def split_summary(spark, sf):
    rows = with_split(c.multitask_labels(b.impressions(spark, sf)), dates=b.SPLIT)
    return b.rounded(profiling.split_summary(rows, ["is_click", "watch_greater_30s"]))


def dates(spark, sf):
    out = profiling.date_counts(b.impressions(spark, sf), "imp_timestamp", last=10)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "rows")


def balance(spark, sf):
    return b.rounded(profiling.user_balance(b.impressions(spark, sf), "is_click"))


def class_weight(spark, sf):
    return b.rounded(profiling.positive_weight(b.table(spark, sf, "labels"), "quality"))


def accounting(spark, sf):
    imp = b.impressions(spark, sf)
    return profiling.row_accounting(imp, retrieval_splits(imp, b.SPLIT))


def duplicates(spark, sf):
    return profiling.duplicate_keys(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def missing(spark, sf):
    docs = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left")
    return b.rounded(profiling.missingness(docs))


def describe(spark, sf):
    return b.rounded(profiling.describe(b.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 9)


def values(spark, sf):
    return profiling.value_counts(b.impressions(spark, sf), "live_content_category_le")


def profile(spark, sf):
    return b.rounded(profiling.numeric_profile(b.table(spark, sf, "events"), "value"))


def histogram(spark, sf):
    return profiling.histogram(b.table(spark, sf, "events"), "value", 50)


def checks(spark, sf):
    out = started(spark, sf).withColumn("age", F.col("t_us") - F.col("start_us"))
    feats = build_features(out, ["W5"], measure_keys(out, ["W5"]))
    return profiling.violations(
        feats,
        {
            "negative_age": F.col("age") < 0,
            "future_click": F.col("time_since_last_click_user") < 0,
            "unknown_start": F.col("start_us").isNull(),
        },
    )


def label_codes(spark, sf):
    part = b.table(spark, sf, "part").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)))
    return encoders.label_encode(part, ["p_brand", "p_type", "p_size"]).select(
        "p_partkey", "p_brand_le", "p_type_le", "p_size_le"
    )


def large_codes(spark, sf):
    """E1 on a vocabulary as large as the table: codes counted across ranges."""
    return encoders.label_encode(b.table(spark, sf, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_le")


def vocabulary(spark, sf):
    rows = with_split(b.impressions(spark, sf), dates=b.SPLIT)
    train, rest = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    vocab = encoders.vocabulary([train, rest], "live_content_category_le")
    users = encoders.vocabulary([train], "user_id")
    coded = encoders.encode_vocabulary(rows, "live_content_category_le", vocab, "category_id")
    return encoders.encode_vocabulary(coded, "user_id", users, "user_code").select("event_id", "category_id", "user_code")


def sizes(spark, sf):
    rows = with_split(b.impressions(spark, sf), dates=b.SPLIT)
    train, rest = rows.where(F.col("split") == "train"), rows.where(F.col("split") != "train")
    return encoders.category_sizes([train, rest], ["user_id", "live_id", "live_content_category_le"])


def clamped(spark, sf):
    imp = b.impressions(spark, sf).select("event_id", "live_id", "live_content_category_le")
    return encoders.clamp_categories(imp, {"live_id": 10, "live_content_category_le": 2})


def normalised(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    out = {
        f"{m}_{'c' if q else 'p'}": scalers.normalise("l_extendedprice", scalers.fit_normaliser(lines, "l_extendedprice", m, q))
        for m in ("zscore", "minmax", "robust")
        for q in (None, 0.99)
    }
    return b.rounded(lines.select("l_orderkey", *[e.alias(n) for n, e in out.items()]))


def _scaled(method):
    def run(spark, sf):
        cust = b.table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
        params = scalers.fit_scalers(cust, {"c_acctbal": method, "n": method})
        return b.rounded(scalers.apply_scalers(cust, params))

    return run


def target(spark, sf):
    rows = with_split(c.multitask_labels(b.impressions(spark, sf)), dates=b.SPLIT)
    params = scalers.fit_target(rows.where(F.col("split") == "train"), "watch_live_time_log")
    return b.rounded(rows.select("event_id", scalers.normalise("watch_live_time_log", params).alias("target")))


def minmax(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    bounds = scalers.fit_minmax(lines, {"q": F.col("l_quantity"), "z": F.col("l_quantity") * 0})
    whole = lines.select(
        "l_orderkey", "l_suppkey", "l_extendedprice",
        scalers.unit_range(F.col("l_quantity"), bounds["q"]).alias("unit"),
        scalers.unit_range(F.col("l_quantity") * 0, bounds["z"]).alias("flat"),
    )
    return b.rounded(scalers.unit_range_by(whole, ["l_suppkey"], "l_extendedprice", "by_supplier"))


def scaled_features(spark, sf):
    """The scaling stage over the user's count and click families."""
    imp = b.impressions(spark, sf)
    feats = build_features(imp, ["W1", "W2", "W3"], measure_keys(imp, ["W1", "W2", "W3"]))
    keep = ["ctr_user_7d", "num_imp_user_7d", "num_click_user_1d", "click_trend_user"]
    out = scale_features(feats.select("event_id", *keep), columns=keep)
    ctr = (F.round("ctr_user_7d", 6) + F.lit(0.0)).alias("ctr_user_7d")
    return out.select("event_id", ctr, *[(F.round(x, 5) + F.lit(0.0)).alias(x) for x in keep[1:]])


def retrieval_split(spark, sf):
    return retrieval_splits(b.impressions(spark, sf), b.SPLIT).select("event_id", "split")


def ranking_split(spark, sf):
    out = ranking_splits(b.impressions(spark, sf), ["event_id", "is_click", "watch_greater_30s", "watch_live_time", "absent"], b.SPLIT)
    return b.rounded(out)


def union_splits(spark, sf):
    rows = with_split(b.impressions(spark, sf), dates=b.SPLIT)
    parts = [rows.where(F.col("split") == s) for s in ("train", "val", "test")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.max("live_id").alias("max_live"))


def pairs(spark, sf):
    return dedup.distinct_pairs(b.impressions(spark, sf), ["user_id", "live_id", "streamer_id"])


def per_user_parts(spark, sf):
    """Per-user results of several list lengths put together."""
    imp = b.impressions(spark, sf).select("user_id", "event_id", "watch_live_time")
    order = [F.col("watch_live_time").desc(), "event_id"]
    return top_k(imp, ["user_id"], order, 3).withColumn("part", F.lit("short")).unionByName(
        top_k(imp, ["user_id"], order, 5).withColumn("part", F.lit("long"))
    )


QUERIES = {
    "J1_likes": likes,
    "J1b_comments": comments,
    "J1c_gifts": gifts,
    "J1c_gifts_sliced": gifts_sliced,
    "J2_dimensions": dimension_join,
    "J3_vectors": vector_join,
    "J4_handoff": handoff,
    "J6_anti": anti_join,
    "J7_labels": label_join,
    "J8_indicator": indicator,
    "J9_pool_index": pool_index,
    "J10_hits": hits,
    "U1_interactions": interactions,
    "U2_timeline": event_timeline,
    "U3_intersection": shared,
    "U4_union_splits": union_splits,
    "U5_concat": per_user_parts,
    "U6_pairs": pairs,
    "M13_overlap": overlap,
    "A1_positives": positives,
    "A2_mode": frequent,
    "A3_latest": latest,
    "A4_click_priority": click_priority,
    "A4_retrieval_split": retrieval_split,
    "P12_ranking_split": ranking_split,
    "A5_first": first,
    "A6_unique": unique,
    "A6_unique_by_user": unique_by_user,
    "A7_quantiles": quantiles,
    "A7_quantiles_bracketed": quantiles_bracketed,
    "A8_split_summary": split_summary,
    "A9_dates": dates,
    "A10_balance": balance,
    "A12_class_weight": class_weight,
    "A13_accounting": accounting,
    "A14_duplicates": duplicates,
    "A15_missing": missing,
    "A16_describe": describe,
    "A16_value_counts": values,
    "A17_profile": profile,
    "A17_histogram": histogram,
    "A18_checks": checks,
    "E1_label_codes": label_codes,
    "E1_large_codes": large_codes,
    "E2_vocabulary": vocabulary,
    "E3_sizes": sizes,
    "E3_clamp": clamped,
    "E4_normalise": normalised,
    "E5_log_clip_std": _scaled("log_clip_std"),
    "E6_clip_std": _scaled("clip_std"),
    "E7_log_std": _scaled("log_std"),
    "E8_std": _scaled("std"),
    "E9_target": target,
    "E10_minmax": minmax,
    "E_scaled_features": scaled_features,
}

_CLK = "imp WHERE is_click = 1"
_PAIR = "user_id, live_id, streamer_id"
_A4 = (
    "row_number() OVER (PARTITION BY live_id, streamer_id, user_id ORDER BY is_click DESC, "
    "CASE WHEN is_click = 1 THEN t_us ELSE -t_us END NULLS LAST, event_id) = 1"
)
_SPLIT = b.split_sql("ts")
_TT = f"{b.IMP}, s AS (SELECT *, {_SPLIT} AS split FROM imp), te AS (SELECT * FROM s WHERE split = 'test'), tr AS (SELECT * FROM s WHERE split = 'train')"


def _r(e, n=6):
    return f"round({e}, {n}) + 0.0"


def _overlap_sql():
    parts = []
    for name, keys in (("users", "user_id"), ("live_ids", "live_id"), ("streamers", "streamer_id"), ("pairs", _PAIR)):
        parts.append(
            f"SELECT '{name}' AS level, count(l) AS candidate_count, count(r) AS other_count, count(*) FILTER (l = 1 AND r = 1) AS overlap_count, "
            f"{_r('count(*) FILTER (l = 1 AND r = 1) / greatest(count(l), 1)::DOUBLE')} AS overlap_rate FROM "
            f"(SELECT DISTINCT {keys}, 1 AS l FROM te) FULL JOIN (SELECT DISTINCT {keys}, 1 AS r FROM tr) USING ({keys})"
        )
    return f"WITH {_TT} " + " UNION ALL ".join(parts)


def _quant(x, q):
    return f"{_r(f'quantile_cont({x}, {q})')} AS {x}_q{int(q * 100):02d}"


def _std_sql(raw: str, low: str | None, high: str | None) -> str:
    def one(col):
        r = raw.format(col)
        bounded = r
        if high:
            bounded = f"least({bounded}, (SELECT quantile_cont({r}, {high}) FROM cu))"
        if low:
            bounded = f"greatest({bounded}, (SELECT quantile_cont({r}, {low}) FROM cu))"
        return bounded

    return (
        "WITH cu AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS n FROM customer), "
        f"x AS (SELECT c_custkey, {one('c_acctbal')} AS a, {one('n')} AS n FROM cu) "
        f"SELECT c_custkey, {_r('(a - (SELECT avg(a) FROM x)) / (SELECT stddev_samp(a) FROM x)')} AS c_acctbal, "
        f"{_r('(n - (SELECT avg(n) FROM x)) / (SELECT stddev_samp(n) FROM x)')} AS n FROM x"
    )


def _norm_sql():
    body, ctes = [], []
    for tag, src in (("p", "l_extendedprice"), ("c", "least(greatest(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 1 - 0.99::DOUBLE) FROM lineitem)), (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem))")):
        ctes.append(f"v{tag} AS (SELECT {src} AS v FROM lineitem), s{tag} AS (SELECT avg(v) AS m, stddev_samp(v) AS s, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM v{tag})")
        body += [f"{_r(f'({src} - s{tag}.m) / s{tag}.s')} AS zscore_{tag}", f"{_r(f'({src} - s{tag}.lo) / (s{tag}.hi - s{tag}.lo)')} AS minmax_{tag}", f"{_r(f'({src} - s{tag}.q2) / (s{tag}.q3 - s{tag}.q1)')} AS robust_{tag}"]
    return f"WITH {', '.join(ctes)} SELECT l_orderkey, {', '.join(body)} FROM lineitem, sp, sc"


_DESC = " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count({x}) AS count, {_r(f'avg({x})', 9)} AS mean, {_r(f'stddev_samp({x})', 9)} AS std, min({x}) AS min, max({x}) AS max, count(DISTINCT {x}) AS \"unique\", "
    + ", ".join(f"{_r(f'quantile_cont({x}, {q})')} AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99))
    + " FROM lineitem"
    for x in ("l_quantity", "l_extendedprice", "l_discount")
)

SQL = {
    "J1_likes": f"WITH {b.INTER} SELECT event_id, latest_like_us, is_like FROM inter WHERE is_click = 1",
    "J1b_comments": f"WITH {b.INTER} SELECT event_id, latest_comment_us, is_comment FROM inter WHERE is_click = 1",
    "J1c_gifts_sliced": f"WITH {b.INTER} SELECT i.event_id, i.latest_gift_us, i.is_gift, a.gift_price FROM inter i LEFT JOIN att a ON i.event_id = a.click_id WHERE is_click = 1",
    "J1c_gifts": f"WITH {b.INTER} SELECT i.event_id, i.latest_gift_us, i.is_gift, a.gift_price FROM inter i LEFT JOIN att a ON i.event_id = a.click_id WHERE is_click = 1",
    "J2_dimensions": f"WITH {b.LINES} SELECT o_custkey AS user_id, l_partkey AS live_id, l_suppkey AS streamer_id, l_orderkey, l_quantity, c_nationkey AS user_country, c_acctbal, p_size, p_brand, s_nationkey AS streamer_country FROM fact LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey",
    "J3_vectors": f"WITH {b.EV}, e AS (SELECT event_id, CASE WHEN live_id = 3 THEN -1 ELSE live_id END AS live_name_id FROM ev), d AS (SELECT live_name_id, row_number() OVER (ORDER BY live_name_id) - 1 AS rid FROM (SELECT DISTINCT live_name_id FROM e WHERE live_name_id <> -1)) SELECT event_id, e.live_name_id, CAST(v.embedding IS NULL AS INTEGER) AS title_emb_missing, coalesce(round(list_sum(CAST(v.embedding AS DOUBLE[])), 6), 0) + 0.0 AS total FROM e LEFT JOIN d USING (live_name_id) LEFT JOIN embeddings v ON v.vec_id = d.rid",
    "J4_handoff": f"WITH {b.IMP}, tk AS (SELECT {_PAIR}, min(event_id) AS e FROM imp GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS rank FROM tk), lt AS (SELECT * FROM imp QUALIFY row_number() OVER (PARTITION BY {_PAIR} ORDER BY t_us DESC, event_id) = 1) SELECT rk.user_id, rk.live_id, rk.streamer_id, CAST(rank AS INTEGER) AS stage1_rank, {_r('e / 7.0::DOUBLE')} AS stage1_score, lt.event_id, lt.is_click FROM rk JOIN lt USING ({_PAIR}) WHERE rank <= 10",
    "J6_anti": f"WITH {b.IMP} SELECT event_id FROM imp a WHERE is_click <> 1 AND NOT EXISTS (SELECT 1 FROM {_CLK} AND imp.live_id = a.live_id AND imp.streamer_id = a.streamer_id AND imp.user_id = a.user_id)",
    "J7_labels": "",
    "J8_indicator": f"WITH {_TT} SELECT DISTINCT {_PAIR} FROM te ANTI JOIN tr USING ({_PAIR}) ORDER BY ALL LIMIT 10",
    "J9_pool_index": f"WITH {b.IMP}, p AS (SELECT live_id, streamer_id, row_number() OVER (ORDER BY live_id, streamer_id) - 1 AS pool_idx FROM (SELECT DISTINCT live_id, streamer_id FROM {_CLK})) SELECT event_id, live_id, streamer_id, pool_idx FROM imp LEFT JOIN p USING (live_id, streamer_id)",
    "J10_hits": f"WITH {b.IMP} SELECT DISTINCT {_PAIR} FROM {_CLK} INTERSECT SELECT {_PAIR} FROM imp WHERE is_click = 0",
    "U1_interactions": f"WITH {b.INTER} SELECT event_id, t_us, user_id, live_id, streamer_id, is_click, watch_live_time, latest_like_us, latest_comment_us, latest_gift_us, is_like, is_comment, is_gift, gift_price, year(ts) AS imp_year, month(ts) AS imp_month, day(ts) AS imp_day, hour(ts) AS imp_hour, CAST(isodow(ts) >= 6 AS INTEGER) AS imp_is_weekend FROM inter",
    "U2_timeline": f"WITH {b.EV} SELECT user_id, live_id, streamer_id, t_us, event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'signup' THEN 'like' WHEN 'error' THEN 'comment' ELSE 'gift' END AS kind, CAST(event_type <> 'click' AS INTEGER) AS after, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM ev WHERE event_type <> 'view'",
    "U3_intersection": f"WITH {_TT} SELECT {_PAIR} FROM te INTERSECT SELECT {_PAIR} FROM tr",
    "U4_union_splits": f"WITH {_TT} SELECT split, count(*) AS rows, max(live_id) AS max_live FROM s WHERE split IS NOT NULL GROUP BY split",
    "U5_concat": f"WITH {b.IMP}, r AS (SELECT user_id, event_id, watch_live_time, row_number() OVER (PARTITION BY user_id ORDER BY watch_live_time DESC, event_id) AS rank FROM imp) SELECT *, 'short' AS part FROM r WHERE rank <= 3 UNION ALL SELECT *, 'long' FROM r WHERE rank <= 5",
    "U6_pairs": f"WITH {b.IMP} SELECT DISTINCT {_PAIR} FROM imp",
    "M13_overlap": _overlap_sql(),
    "A1_positives": f"WITH {b.IMP} SELECT {_PAIR}, max(is_click) AS is_positive FROM imp GROUP BY ALL",
    "A2_mode": f"WITH {b.EV}, n AS (SELECT user_id, live_id, count(*) AS f, max(t_us) AS t FROM ev GROUP BY ALL) SELECT user_id, live_id FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f DESC, t DESC, live_id) = 1",
    "A3_latest": f"WITH {b.IMP} SELECT event_id, {_PAIR}, is_click FROM imp QUALIFY row_number() OVER (PARTITION BY {_PAIR} ORDER BY t_us DESC, event_id) = 1",
    "A4_click_priority": f"WITH {b.IMP} SELECT event_id, {_PAIR}, is_click FROM imp QUALIFY {_A4}",
    "A4_retrieval_split": f"WITH {b.IMP} SELECT event_id, {_SPLIT} AS split FROM imp QUALIFY {_A4}",
    "P12_ranking_split": f"WITH {b.IMP} SELECT event_id, is_click, CAST(watch_live_time >= 30 AS INTEGER) AS watch_greater_30s, watch_live_time, {_SPLIT} AS split FROM imp",
    "A5_first": f"WITH {b.IMP} SELECT user_id, event_id, t_us FROM imp QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) = 1",
    "A6_unique": f"WITH {b.EV} SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT live_id) AS n_live_id, count(DISTINCT streamer_id) AS n_streamer_id FROM ev",
    "A6_unique_by_user": f"WITH {b.IMP} SELECT user_id, count(DISTINCT live_id) AS n_live_id FROM imp GROUP BY user_id",
    "A7_quantiles": "SELECT " + ", ".join(
        f"{_r(f'avg({x})')} AS {x}_mean, {_r(f'stddev_samp({x})')} AS {x}_std, min({x}) AS {x}_min, max({x}) AS {x}_max, "
        + ", ".join(_quant(x, q) for q in (0.01, 0.25, 0.5, 0.99)) for x in ("l_quantity", "l_extendedprice")) + " FROM lineitem",
    "A7_quantiles_bracketed": "SELECT count(*) AS rows, " + ", ".join(
        _quant(x, q) for x in ("l_quantity", "l_extendedprice") for q in (0.01, 0.25, 0.5, 0.99)) + " FROM lineitem",
    "A8_split_summary": f"WITH {b.IMP} SELECT {_SPLIT} AS split, count(*) AS rows, min(t_us) AS min_t, max(t_us) AS max_t, {_r('avg(is_click)')} AS is_click_rate, {_r('avg(CAST(watch_live_time >= 30 AS INTEGER))')} AS watch_greater_30s_rate, {_r('avg(watch_live_time)')} AS watch_live_time_mean, {_r('stddev_pop(watch_live_time)')} AS watch_live_time_std FROM imp GROUP BY 1",
    "A9_dates": f"WITH {b.IMP} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM imp GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "A10_balance": f"WITH {b.IMP}, u AS (SELECT sum(is_click) AS p, sum(1 - is_click) AS n, count(*) AS t FROM imp GROUP BY user_id) SELECT count(*) AS users, {_r('avg(p)')} AS avg_positives, {_r('avg(n)')} AS avg_negatives, {_r('avg(t)')} AS avg_total, {_r('stddev_pop(p)')} AS std_positives, {_r('stddev_pop(n)')} AS std_negatives, {_r('stddev_pop(t)')} AS std_total FROM u",
    "A12_class_weight": f"SELECT count(*) FILTER (quality = 1) AS pos_count, count(*) FILTER (quality = 0) AS neg_count, {_r('count(*) FILTER (quality = 0) / greatest(count(*) FILTER (quality = 1), 1)::DOUBLE')} AS pos_weight FROM labels",
    "A13_accounting": f"WITH {b.IMP}, d AS (SELECT {_SPLIT} AS split FROM imp QUALIFY {_A4}) SELECT (SELECT count(*) FROM imp) AS initial_rows, count(*) AS dedup_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split IS NULL) AS outside_rows, (SELECT count(*) FROM imp) - count(*) AS removed_rows FROM d",
    "A14_duplicates": "SELECT count(*) AS duplicated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_duplicated_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "A15_missing": "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS n_null, {_r(f'(count(*) - count({x})) * 100.0 / count(*)')} AS pct_null FROM d"
        for x in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")),
    "A16_describe": _DESC,
    "A16_value_counts": f"WITH {b.IMP} SELECT cat AS live_content_category_le, count(*) AS rows FROM imp GROUP BY cat",
    "A17_profile": f"WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n, skewness(value) AS sk FROM events), o AS (SELECT count(*) AS k FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) SELECT 'value' AS \"column\", n AS count, {_r('sk')} AS skewness, {_r('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {_r('q3 + 1.5 * (q3 - q1)')} AS upper_bound, k AS outliers, {_r('k * 100.0 / n')} AS outlier_pct FROM q, o",
    "A17_histogram": "WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS rows FROM events, m GROUP BY 1",
    "A18_checks": f"WITH {STARTED} SELECT 'negative_age' AS \"check\", count(*) FILTER (t_us < start_us) AS rows FROM started UNION ALL SELECT 'future_click', 0 UNION ALL SELECT 'unknown_start', count(*) FILTER (start_us IS NULL) FROM started",
    "E1_label_codes": "WITH p AS (SELECT p_partkey, p_brand, p_type, nullif(p_size, 7) AS p_size FROM part) SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand_le, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type_le, CASE WHEN p_size IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY p_size NULLS LAST) - 1 END AS p_size_le FROM p",
    "E1_large_codes": "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS o_totalprice_le FROM orders",
    "E2_vocabulary": f"WITH {_TT}, v AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT coalesce(CAST(cat AS VARCHAR), 'nan') AS t FROM s WHERE split IS NOT NULL)), u AS (SELECT t, row_number() OVER (ORDER BY t) AS id FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS t FROM tr)) SELECT event_id, coalesce(v.id, 0) AS category_id, coalesce(u.id, 0) AS user_code FROM s LEFT JOIN v ON v.t = coalesce(CAST(cat AS VARCHAR), 'nan') LEFT JOIN u ON u.t = CAST(user_id AS VARCHAR)",
    "E3_sizes": f"WITH {b.IMP} SELECT 'user_id' AS \"column\", max(user_id) + 1 AS size FROM imp UNION ALL SELECT 'live_id', max(live_id) + 1 FROM imp UNION ALL SELECT 'live_content_category_le', max(coalesce(cat, 0)) + 1 FROM imp",
    "E3_clamp": f"WITH {b.IMP} SELECT event_id, least(greatest(live_id, 0), 9) AS live_id, least(greatest(coalesce(cat, 0), 0), 1) AS live_content_category_le FROM imp",
    "E4_normalise": _norm_sql(),
    "E5_log_clip_std": _std_sql("ln(1 + greatest({}, 0))", None, "0.99"),
    "E6_clip_std": _std_sql("{}", "0.01", "0.99"),
    "E7_log_std": _std_sql("ln(1 + greatest({}, 0))", None, None),
    "E8_std": _std_sql("{}", None, None),
    "E9_target": f"WITH {b.IMP}, x AS (SELECT event_id, ln(1 + watch_live_time) AS y, {_SPLIT} AS split FROM imp), t AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM x WHERE split = 'train') SELECT event_id, {_r('(y - m) / s')} AS target FROM x, t",
    "E10_minmax": f"WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), g AS (SELECT l_suppkey, min(l_extendedprice) AS glo, max(l_extendedprice) AS ghi FROM lineitem GROUP BY 1) SELECT l_orderkey, l_suppkey, l_extendedprice, {_r('(l_quantity - lo) / (hi - lo)')} AS unit, 0.0::DOUBLE AS flat, CASE WHEN ghi > glo THEN {_r('(l_extendedprice - glo) / (ghi - glo)')} ELSE 0 END AS by_supplier FROM lineitem JOIN g USING (l_suppkey), m",
}


def _scaled_features_sql():
    from tidemark.workloads import window_queries as w

    src = f"{b.IMP}, f AS (SELECT * FROM ({w.SELECTS['W1']}) JOIN ({w.SELECTS['W2']}) USING (event_id) JOIN ({w.SELECTS['W3']}) USING (event_id))"
    raw = {"num_imp_user_7d": "ln(1 + num_imp_user_7d)", "num_click_user_1d": "ln(1 + num_click_user_1d)", "click_trend_user": "click_trend_user"}
    cols = ["event_id", "ctr_user_7d"]
    bounded = []
    for name, r in raw.items():
        e = f"least({r}, (SELECT quantile_cont({r}, 0.99) FROM f))"
        if name == "click_trend_user":
            e = f"greatest({e}, (SELECT quantile_cont({r}, 0.01) FROM f))"
        bounded.append(f"{e} AS {name}")
        cols.append(f"round(({name} - (SELECT avg({name}) FROM x)) / (SELECT coalesce(nullif(stddev_samp({name}), 0), 1) FROM x), 5) + 0.0 AS {name}")
    return f"WITH {src}, x AS (SELECT event_id, ctr_user_7d, {', '.join(bounded)} FROM f) SELECT {', '.join(cols)} FROM x"


SQL["E_scaled_features"] = _scaled_features_sql()


def _label_join_sql():
    from tidemark.workloads.scalar_queries import SCORED_LABELS

    late = "t_us DESC, event_id"
    return (
        f"WITH {SCORED_LABELS}, f AS (SELECT {_PAIR}, arg_min(score_ctr, event_id) AS score_ctr FROM scored GROUP BY {_PAIR}), "
        f"l AS (SELECT {_PAIR}, is_click, watch_greater_30s, is_like FROM scored QUALIFY row_number() OVER (PARTITION BY {_PAIR} ORDER BY {late}) = 1), "
        f"i AS (SELECT live_id, streamer_id, cat AS live_content_category_le FROM scored QUALIFY row_number() OVER (PARTITION BY live_id, streamer_id ORDER BY {late}) = 1) "
        f"SELECT {_PAIR}, score_ctr, is_click, watch_greater_30s, is_like, live_content_category_le FROM f JOIN l USING ({_PAIR}) LEFT JOIN i USING (live_id, streamer_id)"
    )


SQL["J7_labels"] = _label_join_sql()
