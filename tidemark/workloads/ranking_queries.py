"""Queries T1-T13, J5, J11, A11, M1-M19, R1-R10, ST1: candidates, ranking, metrics, training sets, stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import candidates, dedup, metrics, ranking, rerank, retrieval, training
from tidemark.operators.bounded import bounded_top_k
from tidemark.plans import evaluation
from tidemark.plans.features import build_features, measure_keys
from tidemark.plans.splits import with_split
from tidemark.session import materialise, new_table_name, shared_folder
from tidemark.streaming.incremental_dedup import current_best, start_incremental
from tidemark.workloads import binding as b
from tidemark.workloads.scalar_queries import SCORED, SCORED_LABELS, scored_impressions

PAIR = ["user_id", "live_id", "streamer_id"]


# ---- rule candidates: customers against parts sold by suppliers ----
def rule_users(spark, sf):
    cust = b.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return cust.select(
        k.alias("user_id"),
        F.nullif(F.col("c_nationkey"), F.lit(24)).cast("double").alias("country"),
        F.when(k % 11 != 0, k % 10).cast("double").alias("age"),
        (k % 3).cast("double").alias("brand"),
        F.when(k % 13 != 0, k % 8).cast("double").alias("price"),
    )


def rule_items(spark, sf):
    """Parts as lives, each run by the supplier of its latest order line."""
    line = b.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.max(F.struct("l_shipdate", "l_suppkey", "l_orderkey")).alias("last"),
        F.sum("l_quantity").alias("num_click_room_1d"),
        F.count(F.lit(1)).alias("num_imp_room_1d"),
        F.avg("l_discount").alias("ctr_room_12hr"),
    )
    part = b.table(spark, sf, "part")
    supp = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    items = line.select("l_partkey", F.col("last.l_suppkey").alias("streamer_id"), F.col("last.l_shipdate").alias("d"), "num_click_room_1d", "num_imp_room_1d", "ctr_room_12hr")
    return (
        items.join(part, items["l_partkey"] == part["p_partkey"])
        .join(supp, F.col("streamer_id") == F.col("s_suppkey"))
        .select(
            F.col("l_partkey").alias("live_id"), "streamer_id", "num_click_room_1d", "num_imp_room_1d", "ctr_room_12hr",
            F.col("p_retailprice").alias("time_since_live_start"),
            (F.col("p_size") % 2).alias("title_emb_missing"),
            F.col("d").cast("date").alias("live_start_date"),
            F.when(F.col("p_size") % 6 != 0, F.col("p_size") % 5).alias("live_type"),
            F.nullif(F.col("s_nationkey"), F.lit(0)).cast("double").alias("country"),
            F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 10).cast("double").alias("age"),
            (F.col("l_partkey") % 3).cast("double").alias("brand"),
            F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 8).cast("double").alias("price"),
        )
    )


def profiled_candidates(spark, sf):
    """Candidates from profiles that are built from a feature table."""
    imp, e = b.impressions(spark, sf), F.col("event_id")
    features = imp.withColumns(
        {
            "user_country_le": F.col("user_id") % 4, "user_age_le": e % 9, "streamer_country_le": F.col("live_id") % 4,
            "streamer_age_le": e % 7, "ctr_room_12hr": (e % 100) / 100.0, "num_imp_room_1d": e % 50,
        }
    )
    items = candidates.item_score(materialise(candidates.item_profiles(features)))
    items = items.withColumn("rule_score", F.round("rule_score", 9))
    users = candidates.user_profiles(features)
    return b.rounded(candidates.rule_candidates(users, items, 10, max_price_gap=-1))


def item_scores(spark, sf):
    return b.rounded(candidates.item_score(rule_items(spark, sf)).select("live_id", "streamer_id", "rule_score"))


def global_rules(spark, sf):
    out = candidates.global_item_rules(rule_items(spark, sf), "2001-10-31", 120)
    return b.rounded(candidates.item_score(out).select("live_id", "rule_score"))


def _rule_candidates(spark, sf, k=20, **options):
    items = candidates.item_score(materialise(rule_items(spark, sf))).withColumn("rule_score", F.round("rule_score", 9))
    return candidates.rule_candidates(rule_users(spark, sf), items, k, **options)


def rule_top(spark, sf):
    return b.rounded(_rule_candidates(spark, sf))


def rule_strict(spark, sf):
    return b.rounded(_rule_candidates(spark, sf, 10, strict_brand=True, max_age_gap=1, max_price_gap=-1))


def rule_open(spark, sf):
    return b.rounded(_rule_candidates(spark, sf, 10, allow_cross_country=True))


def _bought(spark, sf):
    lines = b.order_lines(spark, sf)
    return lines.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("live_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_positive"),
    ).groupBy("user_id", "live_id").agg(F.max("is_positive").alias("is_positive"))


def marked(spark, sf):
    return b.rounded(candidates.mark_positives(_rule_candidates(spark, sf), _bought(spark, sf)))


def lists(spark, sf):
    return candidates.candidate_lists(_rule_candidates(spark, sf), 10)


def live_recall(spark, sf):
    return b.rounded(metrics.live_recall_by_user(_rule_candidates(spark, sf), _bought(spark, sf), 20))


# ---- vector retrieval: each vector asks for its neighbours; users ask with their own vector ----
def _vectors(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def neighbours(spark, sf):
    v = _vectors(spark, sf)
    out = retrieval.inner_product_top_k(
        v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), 10, 300, 200
    )
    return b.rounded(out)


def _profiles(spark, sf):
    """(queries, items): parts by price, size and a digit, customers by how their purchases differ from the usual.

    Whole numbers, so that equal scores are equal on every engine.
    """
    parts = b.table(spark, sf, "part").withColumns(
        {"v0": F.round("p_retailprice").cast("bigint"), "v1": F.col("p_size") * 40, "v2": F.col("p_partkey") % 10 * 200}
    )
    names = ["v0", "v1", "v2"]
    items = parts.select(F.col("p_partkey").alias("item_id"), F.array(*[F.col(n).cast("double") for n in names]).alias("vector"))
    bought = b.order_lines(spark, sf).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    means = [F.floor(F.sum(n) / F.count(F.lit(1))) - usual for n, usual in zip(names, (1400, 1000, 900))]
    return bought.groupBy(F.col("o_custkey").alias("query_id")).agg(F.array(*[m.cast("double") for m in means]).alias("vector")), items


def _bounded(spark, sf):
    return bounded_top_k(*_profiles(spark, sf), 10, 50, 100)


def bounded(spark, sf):
    return b.rounded(_bounded(spark, sf).found)


def bounded_visits(spark, sf):
    """Queries and items, and whether blocks were skipped."""
    less = (F.col("visited") > 0) & (F.col("visited") < F.col("queries") * F.col("blocks"))
    return _bounded(spark, sf).visits.select("queries", "items", less.alias("below_all"))


def merged(spark, sf):
    v = _vectors(spark, sf)
    items = v.withColumnRenamed("vec_id", "item_id")
    first = retrieval.inner_product_top_k(v.withColumnRenamed("vec_id", "query_id"), items, 10)
    other = v.select((F.col("vec_id") + 1).alias("query_id"), "vector")
    return b.rounded(retrieval.merge_interests(first, retrieval.inner_product_top_k(other, items, 10), 10))


def wide_impressions(spark, sf):
    """Impressions spread over as many lives as there are vectors, so the pool grows with the tables."""
    e = b.table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    live = (F.col("user_id") * 101 + k) % F.lit(max(_vectors(spark, sf).count(), 1))
    return e.select(
        "event_id", "user_id", live.alias("live_id"), (live % 20).alias("streamer_id"), c.micros("ts").alias("t_us"),
        F.col("ts").alias("imp_timestamp"), (F.col("event_type") == "click").cast("int").alias("is_click"),
        F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0).alias("watch_live_time"),
    )


def _user_vectors(spark, sf):
    return _vectors(spark, sf).withColumnRenamed("vec_id", "user_id")


def _item_vectors(spark, sf):
    vectors = _vectors(spark, sf)
    live = F.lit(vectors.count() - 1) - F.col("vec_id")
    return vectors.select(live.alias("live_id"), (live % 20).alias("streamer_id"), "vector")


def latest_interest(spark, sf):
    imp = wide_impressions(spark, sf)
    pool = retrieval.item_pool(imp)
    vectors = _item_vectors(spark, sf).join(pool, ["live_id", "streamer_id"]).select(F.col("pool_idx").alias("item_id"), "vector")
    out = retrieval.second_interest(imp.where(F.col("is_click") == 1), pool, vectors)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return b.rounded(out.select("query_id", total.alias("total")))


def _retrieved(spark, sf, k, interests):
    imp = wide_impressions(spark, sf)
    return retrieval.retrieve(
        imp, _user_vectors(spark, sf), _item_vectors(spark, sf), k, interests, imp.where(F.col("is_click") == 1)
    )


def retrieved(spark, sf):
    return b.rounded(_retrieved(spark, sf, 10, 2))


def recommended(spark, sf):
    """The test days as new rows: users seen on the training days ask with their own vector, others with the mean."""
    imp = with_split(wide_impressions(spark, sf), dates=b.SPLIT)
    seen = imp.where(F.col("split") == "train").select("user_id").distinct()
    new = imp.where(F.col("split") == "test").select("user_id", "live_id", "streamer_id", "t_us", "event_id")
    known = _user_vectors(spark, sf).join(seen, "user_id")
    return b.rounded(retrieval.recommend(new, known, _item_vectors(spark, sf), 10, 2))


def pool_recall(spark, sf):
    return b.rounded(retrieval.pool_recall(wide_impressions(spark, sf), _retrieved(spark, sf, 50, 1), [5, 10, 50]))


def pair_recall(spark, sf):
    imp = wide_impressions(spark, sf)
    return b.rounded(metrics.recall_by_user(imp.where(F.col("is_click") == 1), _retrieved(spark, sf, 20, 2), 20))


def random_recall(spark, sf):
    return b.rounded(retrieval.random_recall(wide_impressions(spark, sf), [10, 50, 100]))


def retrieval_report(spark, sf):
    imp = wide_impressions(spark, sf)
    train = with_split(imp, dates=b.SPLIT).where(F.col("split") == "train")
    return b.rounded(retrieval.retrieval_report(imp, retrieval.item_pool(train)))


def _sweep_inputs(spark, sf):
    imp = wide_impressions(spark, sf)
    clicks = imp.where(F.col("is_click") == 1)
    scored = lambda tag, share, y: F.round(c.hash_fraction("event_id", seed=tag) * share + F.col(y) * (1 - share), 3)
    rows = imp.withColumn("watch_greater_30s", (F.col("watch_live_time") > 30).cast("int")).withColumns(
        {"score_ctr": scored("ctr", 0.8, "is_click"), "score_watch": scored("watch", 0.7, "watch_greater_30s")}
    )
    tasks = {"is_click": ("is_click", "score_ctr"), "watch_greater_30s": ("watch_greater_30s", "score_watch")}
    one, two = retrieval.retrieve_both(imp, _user_vectors(spark, sf), _item_vectors(spark, sf), 50, clicks)
    return {1: one, 2: two}, rows, clicks, [10, 20, 50], tasks


def sweep(spark, sf):
    return b.rounded(evaluation.sweep(*_sweep_inputs(spark, sf)))


def _runs(spark, sf):
    """The grid with a third kind of list that asks for more similarity than unit vectors can have: its runs fail."""
    lists, *rest = _sweep_inputs(spark, sf)
    return b.rounded(evaluation.sweep_runs({**lists, 3: lists[1].where("score > 1.01")}, *rest))


def leaderboard(spark, sf):
    return evaluation.leaderboard(_runs(spark, sf), ["recall_mean", "pair_overlap_rate", "auc_mean", "ndcg@10_is_click"], 5)


def leaderboard_summary(spark, sf):
    return b.rounded(evaluation.run_summary(_runs(spark, sf)))


# ---- ranking metrics on scored impressions ----
TASKS = {
    "is_click": ("is_click", "score_ctr"),
    "watch_greater_30s": ("watch_greater_30s", "score_watch_greater_30s"),
    "is_like": ("is_like", "score_like"),
}
TIES = ["live_id", "streamer_id", "event_id"]


def aucs(spark, sf):
    return b.rounded(metrics.auc(scored_impressions(spark, sf, labels=True), TASKS))


def match_report(spark, sf):
    regression = ("watch_live_time_log", "score_watch_live_time_log")
    latest = dedup.latest_row(scored_impressions(spark, sf, labels=True), PAIR, "t_us", "event_id")
    return b.rounded(evaluation.match_report(latest, TASKS, regression))


def document_auc(spark, sf):
    docs = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents"), "doc_id")
    return b.rounded(metrics.auc(docs, {"quality": ("quality", "n_chars"), "toxic": ("toxic", "n_chars")}))


def auc_mean(spark, sf):
    return b.rounded(metrics.mean_metric(metrics.auc(scored_impressions(spark, sf, labels=True), TASKS)))


def precision(spark, sf):
    return b.rounded(metrics.precision_at_k(scored_impressions(spark, sf), "is_click", "score_ctr", [1, 3, 5, 10], ties=TIES))


def ndcg(spark, sf):
    return b.rounded(metrics.ndcg_at_k(scored_impressions(spark, sf), "watch_greater_30s", "score_watch_greater_30s", [5, 10, 50], ties=TIES))


def triple(spark, sf):
    return b.rounded(metrics.list_metrics(scored_impressions(spark, sf), "is_click", "score_ctr", [5, 10, 20], ties=TIES, suffix="_is_click"))


def regression(spark, sf):
    s = scored_impressions(spark, sf)
    return b.rounded(metrics.regression_errors(s, "watch_live_time_log", "score_watch_live_time_log"))


LOGIT = {t: (y, f"z_{s}", w) for (t, (y, s)), w in zip(TASKS.items(), (1.0, 0.5, 2.0))}


def loss(spark, sf):
    s = scored_impressions(spark, sf, labels=True)
    s = s.withColumns({f"z_{x}": (F.col(x) - 0.5) * 4.0 for _, x in TASKS.values()})
    both = metrics.multitask_loss(s, LOGIT, ("watch_live_time_log", "score_watch_live_time_log", 1.0))
    one = metrics.multitask_loss(s, {"is_click": ("is_click", "z_score_ctr", 1.0)}).withColumn("metric", F.lit("bce"))
    return b.rounded(both.unionByName(one))


def compact(spark, sf):
    s = scored_impressions(spark, sf, labels=True)
    all_metrics = metrics.auc(s, TASKS).unionByName(
        metrics.list_metrics(s, "is_click", "score_ctr", [5, 10], ties=TIES, suffix="_is_click")
    )
    return b.rounded(metrics.compact(all_metrics))


# ---- reranking ----
WEIGHTS = {"score_ctr": 1.0, "score_watch_greater_30s": 1.0, "score_like": 1.0}
CATS = ["streamer_id", "live_type", "live_content_category_le"]
NUMS = ["n1", "n2"]


def candidates_scored(spark, sf):
    """One scored row per pair with item attributes."""
    s = scored_impressions(spark, sf, labels=True)
    one = dedup.first_row(s, PAIR, "event_id")
    return one.withColumns(
        {
            "live_type": (F.col("live_id") % 3).cast("int"),
            "relevance_score": F.round(c.weighted_relevance(WEIGHTS), 6),
            "n1": (F.col("live_id") - 7).cast("double"),
            "n2": (F.col("streamer_id") + 1).cast("double"),
            "age_hours": (F.col("live_id") - 1) / F.lit(2.0),
            "accu_play_cnt_le": (F.col("live_id") * 3 % 11).cast("double"),
        }
    )


def prefiltered(spark, sf):
    out = rerank.prefilter(candidates_scored(spark, sf), 20)
    return b.rounded(out.select(*PAIR, "rank", "relevance_score"))


def _similar(cats, nums):
    def run(spark, sf):
        listed = rerank.prefilter(candidates_scored(spark, sf), 20)
        return b.rounded(rerank.similarity_profile(listed, cats, nums))

    return run


def _mmr(trade_off, cats=CATS, nums=()):
    def run(spark, sf):
        listed = rerank.prefilter(candidates_scored(spark, sf), 20)
        out = rerank.mmr(listed, trade_off, 8, cats, nums)
        return b.rounded(out.select(*PAIR, "rank", "mmr_score"))

    return run


def _listed(spark, sf):
    return rerank.prefilter(candidates_scored(spark, sf), 20)


def diversity(spark, sf):
    return b.rounded(metrics.diversity(_listed(spark, sf), 5))


def freshness(spark, sf):
    return b.rounded(metrics.freshness(_listed(spark, sf), 5, "age_hours"))


def popularity(spark, sf):
    return b.rounded(metrics.popularity(_listed(spark, sf), 5, "accu_play_cnt_le"))


def delta(spark, sf):
    listed = _listed(spark, sf)
    before, after = metrics.diversity(listed, 5), metrics.diversity(listed, 10)
    return b.rounded(metrics.metric_delta(before, after))


def rerank_report(spark, sf):
    out = evaluation.rerank_report(
        candidates_scored(spark, sf).drop("relevance_score"), WEIGHTS, CATS, pool=20, top_n=8, ks=(3, 5),
        age_hours="age_hours", popular="accu_play_cnt_le",
    )
    return b.rounded(out)


# ---- training sets ----
def fresh(spark, sf):
    return b.rounded(training.freshness_weight(b.impressions(spark, sf), 72.0).select("event_id", "weight"))


def weak_weight(spark, sf):
    out = training.weigh_weak_positives(training.freshness_weight(b.impressions(spark, sf), 72.0), 0.3)
    return b.rounded(out.select("event_id", "weight"))


def weak_drop(spark, sf):
    return training.drop_weak_positives(b.impressions(spark, sf)).select("event_id")


def only_positives(spark, sf):
    return training.positives_only(b.impressions(spark, sf)).select("event_id")


def capped(spark, sf):
    return training.cap_per_user(training.positives_only(b.impressions(spark, sf)), 4).select("event_id", "user_id")


def cap_report(spark, sf):
    return training.capped_rows(training.positives_only(b.impressions(spark, sf)), 4)


def rebalanced(spark, sf):
    docs = b.table(spark, sf, "labels")
    return training.rebalance(docs, "toxic", "doc_id").select("doc_id", "copy")


def hard(spark, sf):
    imp = wide_impressions(spark, sf)
    out = training.hard_negatives(imp, _user_vectors(spark, sf), _item_vectors(spark, sf))
    return b.rounded(out)


def guarded(spark, sf):
    rows = with_split(b.impressions(spark, sf), dates=b.SPLIT).where(F.col("split") == "test")
    return training.guarded_split(rows).select("event_id", "split")


RANK_FEATURES = ["ctr_user_7d", "num_imp_user_7d", "click_trend_user", "imp_hour"]
HEADS = {"is_click": "score_ctr", "watch_greater_30s": "score_watch_greater_30s", "is_like": "score_like"}
REG = ("watch_live_time_log", "score_watch_live_time_log")


def ranker(spark, sf):
    sizes = measure_keys(b.impressions(spark, sf), ["W1", "W2", "W3"])
    feats = build_features(b.interactions(spark, sf), ["W1", "W2", "W3"], sizes)
    rows = with_split(c.multitask_labels(feats), dates=b.SPLIT)
    train = rows.where(F.col("split") == "train")
    model = training.fit_ranker(train, RANK_FEATURES, HEADS, REG)
    test = rows.where(F.col("split") == "test")
    out = training.score_rows(model, test, HEADS, REG)
    return b.rounded(out.select("event_id", *HEADS.values(), REG[1], "score_multitask_mean"))


def ranker_optimum(spark, sf):
    """Each head stands where its loss has no slope."""
    sizes = measure_keys(b.impressions(spark, sf), ["W1", "W2", "W3"])
    feats = build_features(b.interactions(spark, sf), ["W1", "W2", "W3"], sizes)
    train = materialise(with_split(c.multitask_labels(feats), dates=b.SPLIT).where(F.col("split") == "train"))
    model = training.fit_ranker(train, RANK_FEATURES, HEADS, REG, rounds=200)
    found = training.ranker_gradients(model, train, RANK_FEATURES, HEADS, REG)
    return found.select("head", "rows", (F.col("gradient") < 1e-3).alias("at_optimum"))


def factors_solved(spark, sf):
    """Users whose vector solves its normal equations up to single precision."""
    lines = b.order_lines(spark, sf)
    pairs = materialise(lines.groupBy(F.col("o_custkey").cast("int").alias("user_id"), F.col("l_partkey").cast("int").alias("item_id")).agg(
        F.sum("l_quantity").cast("float").alias("weight")
    ))
    users, items = training.factor_vectors(pairs, rank=8, rounds=3)
    gaps = training.factor_residuals(pairs, users, materialise(items))
    return gaps.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("residual") < 1e-3).alias("solved"))


def ranker_calibration(spark, sf):
    """On its training rows a logistic head with an intercept predicts the label's rate, and the mean score is the heads' mean."""
    sizes = measure_keys(b.impressions(spark, sf), ["W1", "W2", "W3"])
    feats = build_features(b.interactions(spark, sf), ["W1", "W2", "W3"], sizes)
    train = materialise(with_split(c.multitask_labels(feats), dates=b.SPLIT).where(F.col("split") == "train"))
    scored = training.score_rows(training.fit_ranker(train, RANK_FEATURES, HEADS, REG), train, HEADS, REG)
    mean = sum((F.col(s) for s in HEADS.values()), F.lit(0.0)) / len(HEADS)
    row = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.abs(F.col("score_multitask_mean") - mean)).alias("off"),
        *[F.avg(F.col(s) - F.col(y)).alias(f"gap_{y}") for y, s in HEADS.items()],
    )
    heads = F.array(*[F.struct(F.lit(y).alias("head"), (F.abs(f"gap_{y}") < 0.01).alias("calibrated")) for y in HEADS])
    out = row.select("rows", (F.col("off") < 1e-9).alias("mean_of_heads"), F.explode(heads).alias("h"))
    return out.select("h.head", "rows", "h.calibrated", "mean_of_heads")


def factors(spark, sf):
    lines = b.order_lines(spark, sf)
    pairs = materialise(lines.groupBy(F.col("o_custkey").cast("int").alias("user_id"), F.col("l_partkey").cast("int").alias("item_id")).agg(
        F.sum("l_quantity").cast("float").alias("weight")
    ))
    users, items = training.factor_vectors(pairs, rank=8, rounds=3)
    return users.select(F.col("user_id").alias("id"), F.size("vector").alias("width"), F.lit("user").alias("side")).unionByName(
        items.select(F.col("item_id").alias("id"), F.size("vector").alias("width"), F.lit("item").alias("side"))
    )


def streamed(spark, sf):
    """ST1: the event log as a stream of files; the final state equals the batch operator."""
    base = f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    rows = b.impressions(spark, sf).select(*dedup.KEYS, "is_click", "t_us", "event_id")
    rows.repartition(6, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    target = new_table_name(spark)
    start_incremental(stream, target, f"{base}/state").awaitTermination()
    return current_best(spark, target).select(*dedup.KEYS, "is_click", "event_id")


def sorted_rows(spark, sf):
    """Total order over a log, kept at the sink."""
    rows = b.impressions(spark, sf).select("t_us", *PAIR, "event_id")
    return rows.orderBy("t_us", *PAIR, "event_id")


def user_top(spark, sf):
    out = ranking.top_k(scored_impressions(spark, sf), ["user_id"], [F.col("score_ctr").desc(), *TIES], 5)
    return b.rounded(out.select("user_id", "event_id", "rank", "score_ctr"))


QUERIES = {
    "T1_sort": sorted_rows,
    "T2_item_score": item_scores,
    "P17_global_rules": global_rules,
    "J5_rule_candidates": rule_top,
    "J5_rule_strict": rule_strict,
    "J5_rule_open": rule_open,
    "J5_profiles": profiled_candidates,
    "T3_user_top": user_top,
    "J11_mark_positives": marked,
    "A11_lists": lists,
    "M7_live_recall": live_recall,
    "T4_inner_product": neighbours,
    "T5_merge_interests": merged,
    "T6_second_interest": latest_interest,
    "T7_retrieve": retrieved,
    "T7_new_rows": recommended,
    "T4_bounded": bounded,
    "T4_bounded_visits": bounded_visits,
    "M6_pair_recall": pair_recall,
    "M8_pool_recall": pool_recall,
    "M9_random_recall": random_recall,
    "M10_retrieval_report": retrieval_report,
    "M19_sweep": sweep,
    "T13_leaderboard": leaderboard,
    "T13_summary": leaderboard_summary,
    "M1_auc": aucs,
    "M_match_report": match_report,
    "M1_auc_documents": document_auc,
    "M2_auc_mean": auc_mean,
    "M3_precision": precision,
    "M4_ndcg": ndcg,
    "M5_list_metrics": triple,
    "M11_regression": regression,
    "M12_loss": loss,
    "M18_compact": compact,
    "T8_prefilter": prefiltered,
    "T9_category_similarity": _similar(CATS, []),
    "T10_cosine_similarity": _similar([], NUMS),
    "T11_blended_similarity": _similar(CATS, NUMS),
    "T12_mmr": _mmr(0.7),
    "T12_mmr_relevance_only": _mmr(1.0),
    "T12_mmr_blended": _mmr(0.5, CATS, NUMS),
    "M14_diversity": diversity,
    "M15_freshness": freshness,
    "M16_popularity": popularity,
    "M17_delta": delta,
    "T12_rerank_report": rerank_report,
    "R1_freshness": fresh,
    "R2_weak_weight": weak_weight,
    "R2_weak_drop": weak_drop,
    "R3_positives": only_positives,
    "R4_cap": capped,
    "R4_cap_report": cap_report,
    "R5_rebalance": rebalanced,
    "R6_hard_negatives": hard,
    "R8_guard": guarded,
    "R9_ranker": ranker,
    "R9_calibration": ranker_calibration,
    "R10_factors": factors,
    "R9_optimum": ranker_optimum,
    "R10_solved": factors_solved,
    "ST1_stream_dedup": streamed,
}


_PROFILES = f"""WITH {b.LINES},
items AS (
  SELECT p_partkey AS item_id, CAST(round(p_retailprice) AS BIGINT) AS v0, p_size * 40 AS v1, p_partkey % 10 * 200 AS v2 FROM part),
users AS (
  SELECT o_custkey AS query_id, CAST(floor(sum(v0) / count(*)) AS BIGINT) - 1400 AS u0,
         CAST(floor(sum(v1) / count(*)) AS BIGINT) - 1000 AS u1, CAST(floor(sum(v2) / count(*)) AS BIGINT) - 900 AS u2
  FROM fact JOIN items ON l_partkey = item_id GROUP BY o_custkey)"""


def _r(e: str) -> str:
    return f"round({e}, 6) + 0.0"


_P = "user_id, live_id, streamer_id"
ITEMS = """items0 AS (
  SELECT l_partkey AS live_id, arg_max(l_suppkey, (l_shipdate, l_suppkey, l_orderkey)) AS streamer_id, max(l_shipdate) AS d,
         sum(l_quantity) AS q, count(*) AS n, avg(l_discount) AS ctr FROM lineitem GROUP BY l_partkey),
items1 AS (
  SELECT live_id, streamer_id, q, n, ctr, d, p_retailprice AS t, p_size % 2 AS miss,
         CASE WHEN p_size % 6 <> 0 THEN p_size % 5 END AS live_type, nullif(s_nationkey, 0) AS country,
         CASE WHEN p_size % 9 <> 0 THEN p_size % 10 END AS age, live_id % 3 AS brand,
         CASE WHEN live_id % 7 <> 0 THEN live_id % 8 END AS price
  FROM items0 JOIN part ON live_id = p_partkey JOIN supplier ON streamer_id = s_suppkey)"""


def _score(src: str, name: str) -> str:
    def unit(e):
        return f"(({e}) - min({e}) OVER ()) / nullif(max({e}) OVER () - min({e}) OVER (), 0)"

    return (
        f"{name} AS (SELECT *, 0.45 * {unit('ln(1 + q)')} + 0.10 * {unit('ln(1 + n)')} + 0.25 * {unit('ctr')} "
        f"+ 0.08 * (1 - {unit('t')}) - 0.05 * miss AS rule_score FROM {src})"
    )


USERS = """users AS (
  SELECT c_custkey AS user_id, nullif(c_nationkey, 24) AS country, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 10 END AS age,
         c_custkey % 3 AS brand, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 8 END AS price FROM customer)"""


def _near(side, gap):
    return f"(u.{side} IS NULL OR i.{side} IS NULL OR abs(u.{side} - i.{side}) <= {gap})"


def _equal(side):
    return f"(u.{side} IS NULL OR i.{side} IS NULL OR u.{side} = i.{side})"


def _rules(k, *conditions):
    return (
        f"WITH {ITEMS}, {_score('items1', 'items2')}, items AS (SELECT * REPLACE (round(rule_score, 9) AS rule_score) FROM items2), {USERS}, "
        f"cand AS (SELECT u.user_id, i.live_id, i.streamer_id, row_number() OVER (PARTITION BY u.user_id ORDER BY i.rule_score DESC, i.live_id, i.streamer_id) AS rank, {_r('i.rule_score')} AS rule_score "
        f"FROM users u JOIN items i ON i.streamer_id <> u.user_id AND {' AND '.join(conditions)} QUALIFY rank <= {k})"
    )


_BASIC = _rules(20, _equal("country"), _near("age", 3), _near("price", 3))
_BOUGHT = ", bought AS (SELECT o_custkey AS user_id, l_partkey AS live_id, max(CAST(l_returnflag = 'R' AS INTEGER)) AS is_positive FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_WIDE = """imp AS (
  SELECT event_id, user_id, live AS live_id, live % 20 AS streamer_id, epoch_us(ts) AS t_us, ts,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
         CASE WHEN event_type = 'click' AND value > 30 THEN 1 ELSE 0 END AS watch_greater_30s
  FROM (SELECT *, (user_id * 101 + CAST(json_extract(props, '$.k') AS BIGINT)) % (SELECT count(*) FROM embeddings) AS live FROM events)
  WHERE event_type IN ('click', 'view')),
pool AS (SELECT live_id, streamer_id, row_number() OVER (ORDER BY live_id, streamer_id) - 1 AS pool_idx FROM (SELECT DISTINCT live_id, streamer_id FROM imp)),
iv AS (SELECT p.*, CAST(e.embedding AS DOUBLE[]) AS v FROM pool p JOIN embeddings e ON e.vec_id = (SELECT count(*) - 1 FROM embeddings) - p.live_id AND p.streamer_id = p.live_id % 20),
q1 AS (SELECT user_id, CAST(e.embedding AS DOUBLE[]) AS v FROM (SELECT DISTINCT user_id FROM imp) JOIN embeddings e ON e.vec_id = user_id),
q2 AS (SELECT l.user_id, iv.v FROM (SELECT user_id, live_id, streamer_id FROM imp WHERE is_click = 1
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) = 1) l JOIN iv USING (live_id, streamer_id))"""


def _retrieved_sql(k: int) -> str:
    def top(q):
        return (
            f"SELECT user_id, pool_idx, list_dot_product({q}.v, iv.v) AS score FROM {q}, iv "
            f"QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pool_idx) <= {k}"
        )

    return (
        f"WITH {_WIDE}, t1 AS ({top('q1')}), t2 AS ({top('q2')}), "
        f"r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pool_idx) AS rank FROM t1), "
        f"m AS (SELECT user_id, pool_idx, max(score) AS score FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY ALL), "
        f"r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pool_idx) AS rank FROM m QUALIFY rank <= {k}), "
        "l1 AS (SELECT user_id, rank, pool_idx, live_id, streamer_id, score FROM r1 JOIN pool USING (pool_idx)), "
        "l2 AS (SELECT user_id, rank, pool_idx, live_id, streamer_id, score FROM r2 JOIN pool USING (pool_idx)), "
        f"gt AS (SELECT DISTINCT {_P} FROM imp WHERE is_click = 1)"
    )


_AUC = "(sum(CASE WHEN {y} = 1 THEN rk END) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2.0) / nullif(count(*) FILTER ({y} = 1) * count(*) FILTER ({y} = 0), 0)::DOUBLE"
_MIDRANK = "(rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE)"


def _auc_sql(tasks, source):
    return " UNION ALL ".join(
        f"SELECT 'auc_{t}' AS metric, {_r(_AUC.format(y='y'))} AS value FROM (SELECT {y} AS y, {_MIDRANK.format(s=s)} AS rk FROM {source})"
        for t, (y, s) in tasks.items()
    )


def _list_sql(source, y, s, ks, kinds, suffix="", ties=", ".join(TIES)):
    parts = []
    base = (
        f"SELECT user_id, {y}::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY {s} DESC, {ties}) AS rk, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY {y} DESC, {ties}) AS ik FROM {source}"
    )
    for k in ks:
        e = {
            "ndcg": f"sum(y / log2(rk + 1)) FILTER (rk <= {k}) / nullif(sum(y / log2(ik + 1)) FILTER (ik <= {k}), 0)",
            "precision": f"sum(y) FILTER (rk <= {k}) / count(*) FILTER (rk <= {k})",
            "recall": f"sum(y) FILTER (rk <= {k}) / nullif(sum(y), 0)",
        }
        for kind in kinds:
            parts.append(
                f"SELECT '{kind}@{k}{suffix}' AS metric, {_r('avg(v)')} AS value FROM (SELECT {e[kind]} AS v FROM ({base}) GROUP BY user_id)"
            )
    return " UNION ALL ".join(parts)


_ALL = ("ndcg", "precision", "recall")
_LIST = f"""{SCORED_LABELS},
one AS (SELECT *, row_number() OVER (PARTITION BY {_P} ORDER BY event_id) AS rn FROM scored),
cand0 AS (SELECT user_id, live_id, streamer_id, cat, live_id % 3 AS live_type, is_click, watch_greater_30s, is_like,
          round(0.0 + score_ctr + score_watch_greater_30s + score_like, 6) AS rel,
          (live_id - 7)::DOUBLE AS n1, (streamer_id + 1)::DOUBLE AS n2, (live_id - 1) / 2.0::DOUBLE AS age_hours,
          (live_id * 3 % 11)::DOUBLE AS pop FROM one WHERE rn = 1),
listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, live_id, streamer_id) AS rank FROM cand0 QUALIFY rank <= 20)"""
_SIM_CAT = "(CAST(a.streamer_id = b.streamer_id AS INTEGER) + CAST(a.live_type = b.live_type AS INTEGER) + CAST(a.cat IS NOT DISTINCT FROM b.cat AS INTEGER)) / 3.0::DOUBLE"
_SIM_NUM = "(greatest(least((a.n1 * b.n1 + a.n2 * b.n2) / (sqrt(a.n1 * a.n1 + a.n2 * a.n2) * sqrt(b.n1 * b.n1 + b.n2 * b.n2)), 1), -1) + 1) / 2"
_SIM_BOTH = f"(0.7::DOUBLE * ({_SIM_CAT}) + 0.3::DOUBLE * ({_SIM_NUM})) / 1.0"


def _profile_sql(sim):
    return (
        f"WITH {_LIST}, s AS (SELECT a.user_id, a.rank, CASE WHEN a.rank = b.rank THEN 0 ELSE {sim} END AS sim FROM listed a JOIN listed b ON a.user_id = b.user_id) "
        f"SELECT user_id, CAST(rank AS INTEGER) AS rank, {_r('sum(sim) / greatest(count(*) - 1, 1)')} AS mean_similarity, {_r('max(sim)')} AS max_similarity FROM s GROUP BY user_id, rank"
    )


def mmr_ctes(lam, sim, top_n):
    """Greedy selection as a recursion over steps: one row per user, step and candidate still free."""
    return f"""{_LIST},
bounds AS (SELECT user_id, min(rel) AS lo, max(rel) AS hi FROM listed GROUP BY user_id),
c AS (SELECT l.*, CASE WHEN hi > lo THEN (rel - lo) / (hi - lo) ELSE 0 END AS r01 FROM listed l JOIN bounds USING (user_id)),
sims AS (SELECT a.user_id, a.rank AS i, b.rank AS j, {sim} AS sim FROM c a JOIN c b ON a.user_id = b.user_id),
steps AS (
  SELECT user_id, 1 AS step, rank AS i, r01, 0.0::DOUBLE AS pen,
         row_number() OVER (PARTITION BY user_id ORDER BY {lam}::DOUBLE * r01 - (1.0::DOUBLE - {lam}::DOUBLE) * 0.0 DESC, rank) AS pick FROM c
  UNION ALL
  SELECT p.user_id, p.step + 1, p.i, p.r01,
         CASE WHEN p.step = 1 THEN s.sim ELSE greatest(p.pen, s.sim) END AS pen2,
         row_number() OVER (PARTITION BY p.user_id ORDER BY {lam}::DOUBLE * p.r01 - (1.0::DOUBLE - {lam}::DOUBLE) * (CASE WHEN p.step = 1 THEN s.sim ELSE greatest(p.pen, s.sim) END) DESC, p.i)
  FROM steps p JOIN steps w ON w.user_id = p.user_id AND w.pick = 1
  JOIN sims s ON s.user_id = p.user_id AND s.i = p.i AND s.j = w.i
  WHERE p.pick > 1 AND p.step < {top_n}),
mmr AS (SELECT c.*, step, {lam}::DOUBLE * s.r01 - (1.0::DOUBLE - {lam}::DOUBLE) * s.pen AS mmr_score FROM steps s JOIN c ON c.user_id = s.user_id AND c.rank = s.i WHERE s.pick = 1)"""


def _mmr_sql(lam, sim, top_n=8):
    return f"WITH RECURSIVE {mmr_ctes(lam, sim, top_n)} SELECT {_P}, CAST(step AS INTEGER) AS rank, {_r('mmr_score')} AS mmr_score FROM mmr"


def _div_sql(source, n, rank="rank"):
    q = (
        f"(SELECT avg(a) AS ms, avg(bb) AS mt FROM (SELECT count(DISTINCT streamer_id) AS a, count(DISTINCT live_type) AS bb FROM {source} WHERE {rank} <= {n} GROUP BY user_id)) m, "
        f"(SELECT count(DISTINCT streamer_id) FILTER ({rank} <= {n}) / count(DISTINCT streamer_id)::DOUBLE AS cs, count(DISTINCT live_type) FILTER ({rank} <= {n}) / count(DISTINCT live_type)::DOUBLE AS ct FROM {source}) v"
    )
    names = {"diversity_unique_streamers_mean@N": "ms", "diversity_unique_live_types_mean@N": "mt", "diversity_streamer_coverage@N": "cs", "diversity_live_type_coverage@N": "ct"}
    return " UNION ALL ".join(f"SELECT '{n_}' AS metric, {_r(e)} AS value FROM {q}" for n_, e in names.items())


def _fresh_sql(source, n, rank="rank"):
    return (
        f"SELECT 'freshness_avg_age@N' AS metric, {_r('avg(age_hours)')} AS value FROM {source} WHERE {rank} <= {n} UNION ALL "
        f"SELECT 'freshness_score_mean@N', {_r('avg(exp(-greatest(age_hours, 0) * ln(2) / 6))')} FROM {source} WHERE {rank} <= {n}"
    )


def _pop_sql(source, n, rank="rank"):
    raw = f"avg(pop) FILTER ({rank} <= {n})"
    return (
        f"SELECT 'popularity_mean_raw@N' AS metric, {_r(raw)} AS value FROM {source} UNION ALL "
        f"SELECT 'popularity_mean_norm@N', {_r(f'({raw} - min(pop)) / (max(pop) - min(pop))')} FROM {source}"
    )


def _plain(sql: str) -> str:
    """The same metrics without rounding, for differences."""
    return sql.replace("round(", "(").replace(", 6) + 0.0", ")")


def _report_sql():
    ctes = mmr_ctes("0.7", _SIM_CAT, 8)
    ctes += ", b8 AS (SELECT * FROM listed WHERE rank <= 8)"

    def part(source, score, rank):
        pieces = [
            _list_sql(source, t, score, (3, 5), _ALL, f"_{t}", "live_id, streamer_id") for t in TASKS
        ]
        return " UNION ALL ".join([*pieces, _div_sql(source, 8, rank), _fresh_sql(source, 8, rank), _pop_sql(source, 8, rank)])

    return (
        f"WITH RECURSIVE {ctes}, bf AS ({_plain(part('b8', 'rel', 'rank'))}), af AS ({_plain(part('mmr', 'mmr_score', 'step'))}) "
        f"SELECT metric, {_r('bf.value')} AS before, {_r('af.value')} AS after, {_r('af.value - bf.value')} AS delta FROM bf FULL JOIN af USING (metric)"
    )


def _sweep_sql():
    def score(tag, share, y):
        h = f"('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
        return f"round(({h}) * {share}::DOUBLE + {y} * (1::DOUBLE - {share}::DOUBLE), 3)"

    head = (
        _retrieved_sql(50)
        + f", rr AS (SELECT {_P}, is_click AS y, watch_greater_30s AS z, {score('ctr', 0.8, 'is_click')} AS sy, {score('watch', 0.7, 'watch_greater_30s')} AS sz FROM imp QUALIFY row_number() OVER (PARTITION BY {_P} ORDER BY t_us DESC, event_id) = 1), ug AS (SELECT user_id, count(*) AS g FROM gt GROUP BY user_id)"
    )
    parts = []
    for mi in (1, 2):
        for k in (10, 20, 50):
            cells = f"(SELECT l.{_P.replace(', ', ', l.')}, gt.user_id AS hit, rr.y, rr.z, rr.sy, rr.sz FROM l{mi} l LEFT JOIN gt USING ({_P}) LEFT JOIN rr USING ({_P}) WHERE rank <= {k})"
            auc = {t: f"(SELECT {_AUC.format(y='v')} FROM (SELECT {t} AS v, {_MIDRANK.format(s='s' + t)} AS rk FROM {cells} WHERE y IS NOT NULL))" for t in ("y", "z")}
            placed = f"(SELECT user_id, y, row_number() OVER (PARTITION BY user_id ORDER BY sy DESC, live_id, streamer_id) AS rk, row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS ik FROM {cells} WHERE y IS NOT NULL)"
            per_user = f"(SELECT avg(y) FILTER (rk <= 10) AS pr, sum(y / log2(rk + 1)) FILTER (rk <= 10) / nullif(sum(y / log2(ik + 1)) FILTER (ik <= 10), 0) AS nd FROM {placed} GROUP BY user_id)"
            parts.append(
                f"SELECT {k} AS topk, {mi} AS multi_interest_k, {_r(f'(SELECT sum(h / g::DOUBLE) FROM (SELECT user_id, count(hit) AS h FROM {cells} GROUP BY user_id) JOIN ug USING (user_id)) / (SELECT count(*) FROM ug)')} AS recall_mean, "
                f"count(*) AS candidate_pairs, count(y) AS matched_pairs, {_r('count(y) / count(*)::DOUBLE')} AS pair_overlap_rate, "
                f"{_r(auc['y'])} AS auc_is_click, {_r(auc['z'])} AS auc_watch_greater_30s, "
                f"{_r('(SELECT avg(a) FROM (VALUES (' + auc['y'] + '), (' + auc['z'] + ')) t(a))')} AS auc_mean, "
                f"{_r(f'(SELECT avg(pr) FROM {per_user})')} AS \"precision@10_is_click\", {_r(f'(SELECT avg(nd) FROM {per_user})')} AS \"ndcg@10_is_click\" FROM {cells}"
            )
    return head, " UNION ALL ".join(parts)


_HEAD, _GRID = _sweep_sql()


def _bce(y, s):
    z = f"((({s}) - 0.5::DOUBLE) * 4.0::DOUBLE)"
    return f"(ln(1 + exp({z})) - {y} * {z})"


_HUB = "(CASE WHEN abs(least(greatest(score_watch_live_time_log, -8), 8) - watch_live_time_log) < 1 THEN 0.5 * pow(score_watch_live_time_log - watch_live_time_log, 2) ELSE abs(score_watch_live_time_log - watch_live_time_log) - 0.5 END)"
_AGE = "exp(-ln(2) * ((SELECT max(t_us) FROM imp) - t_us) / 3.6e9 / 72)"
_MD = "('0x' || substr(md5(CAST({x} AS VARCHAR) || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

SQL = {
    "T1_sort": f"WITH {b.IMP} SELECT t_us, {_P}, event_id FROM imp ORDER BY ALL",
    "T2_item_score": f"WITH {ITEMS}, {_score('items1', 'i')} SELECT live_id, streamer_id, {_r('rule_score')} AS rule_score FROM i",
    "P17_global_rules": f"WITH {ITEMS}, f AS (SELECT * FROM items1 WHERE CAST(d AS DATE) BETWEEN DATE '2001-10-31' - 120 AND DATE '2001-10-31' AND (live_type IS NULL OR live_type IN (1, 2, 3))), {_score('f', 'i')} SELECT live_id, {_r('rule_score')} AS rule_score FROM i",
    "J5_rule_candidates": f"{_BASIC} SELECT * FROM cand",
    "J5_rule_strict": _rules(10, _equal("country"), _near("age", 1), _equal("brand")) + " SELECT * FROM cand",
    "J5_rule_open": _rules(10, _near("age", 3), _near("price", 3)) + " SELECT * FROM cand",
    "J5_profiles": f"WITH {b.IMP}, ul AS (SELECT user_id, user_id % 4 AS country, event_id % 9 AS age FROM imp QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id) = 1), il AS (SELECT live_id, streamer_id, live_id % 4 AS country, event_id % 7 AS age, (event_id % 100) / 100.0::DOUBLE AS c, ln(1 + event_id % 50) AS n FROM imp QUALIFY row_number() OVER (PARTITION BY live_id ORDER BY t_us DESC, event_id) = 1), sc AS (SELECT *, round(0.10 * (n - min(n) OVER ()) / nullif(max(n) OVER () - min(n) OVER (), 0) + 0.25 * (c - min(c) OVER ()) / nullif(max(c) OVER () - min(c) OVER (), 0), 9) AS s FROM il) SELECT ul.user_id, live_id, streamer_id, CAST(row_number() OVER (PARTITION BY ul.user_id ORDER BY s DESC, live_id, streamer_id) AS INTEGER) AS rank, {_r('s')} AS rule_score FROM ul JOIN sc ON streamer_id <> user_id AND ul.country = sc.country AND abs(ul.age - sc.age) <= 3 QUALIFY rank <= 10",
    "T3_user_top": f"WITH {SCORED} SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score_ctr DESC, live_id, streamer_id, event_id) AS INTEGER) AS rank, score_ctr FROM scored QUALIFY rank <= 5",
    "J11_mark_positives": f"{_BASIC}{_BOUGHT} SELECT cand.*, coalesce(is_positive, 0) AS is_positive FROM cand LEFT JOIN bought USING (user_id, live_id)",
    "A11_lists": f"{_BASIC} SELECT user_id, count(DISTINCT live_id) AS candidate_count, string_agg(CAST(live_id AS VARCHAR), '|' ORDER BY rank) AS item_list FROM cand WHERE rank <= 10 GROUP BY user_id",
    "M7_live_recall": f"{_BASIC}{_BOUGHT} SELECT p.user_id, count(*) AS num_pos, count(h.live_id) AS num_hit, {_r('count(h.live_id) / count(*)::DOUBLE')} AS recall FROM (SELECT * FROM bought WHERE is_positive = 1) p LEFT JOIN cand h USING (user_id, live_id) GROUP BY p.user_id",
    "T7_new_rows": f"""WITH {_WIDE},
new AS (SELECT * FROM imp WHERE {b.split_sql('ts')} = 'test'),
np AS (SELECT live_id, streamer_id, row_number() OVER (ORDER BY live_id, streamer_id) - 1 AS pool_idx FROM (SELECT DISTINCT live_id, streamer_id FROM new)),
nv AS (SELECT np.*, v FROM np JOIN iv USING (live_id, streamer_id)),
seen AS (SELECT DISTINCT q1.user_id, v FROM q1 JOIN imp USING (user_id) WHERE {b.split_sql('ts')} = 'train'),
usual AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(v[i]) AS m FROM seen, range(1, 65) r(i) GROUP BY i)),
asks AS (
  SELECT user_id, coalesce(seen.v, (SELECT v FROM usual)) AS v FROM (SELECT DISTINCT user_id FROM new) LEFT JOIN seen USING (user_id)
  UNION ALL
  SELECT user_id, nv.v FROM (SELECT user_id, live_id, streamer_id FROM new
         QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t_us DESC, event_id DESC) = 1) JOIN nv USING (live_id, streamer_id)),
best AS (SELECT user_id, pool_idx, live_id, streamer_id, max(list_dot_product(asks.v, nv.v)) AS score FROM asks, nv GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pool_idx) AS INTEGER) AS rank, pool_idx, live_id, streamer_id, {_r('score')} AS score
FROM best QUALIFY rank <= 10""",
    "T4_bounded": f"{_PROFILES} SELECT query_id, item_id, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT query_id, item_id, u0 * v0 + u1 * v1 + u2 * v2 AS score FROM users, items) QUALIFY rank <= 10",
    "T4_bounded_visits": f"{_PROFILES} SELECT (SELECT count(*) FROM users) AS queries, (SELECT count(*) FROM items) AS items, true AS below_all",
    "T4_inner_product": f"SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_r(_DOT.format('a.embedding', 'b.embedding'))} AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b QUALIFY rank <= 10",
    "T5_merge_interests": f"WITH d AS (SELECT a.vec_id AS q, b.vec_id AS i, {_DOT.format('a.embedding', 'b.embedding')} AS s FROM embeddings a, embeddings b), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, i) <= 10), m AS (SELECT query_id, item_id, max(s) AS score FROM (SELECT q AS query_id, i AS item_id, s FROM t UNION ALL SELECT q + 1, i, s FROM t) GROUP BY ALL) SELECT query_id, item_id, {_r('score')} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m.score DESC, item_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 10",
    "T6_second_interest": f"WITH {_WIDE} SELECT user_id AS query_id, {_r('list_sum(v)')} AS total FROM q2",
    "T7_retrieve": _retrieved_sql(10) + f" SELECT user_id, CAST(rank AS INTEGER) AS rank, pool_idx, live_id, streamer_id, {_r('score')} AS score FROM l2",
    "M6_pair_recall": _retrieved_sql(20) + f" SELECT gt.user_id, count(*) AS gt_count, count(l2.rank) AS hit_count, {_r('count(l2.rank) / count(*)::DOUBLE')} AS recall FROM gt LEFT JOIN l2 USING ({_P}) GROUP BY gt.user_id",
    "M8_pool_recall": _retrieved_sql(50) + f", u AS (SELECT gt.user_id, count(*) AS n, count(*) FILTER (rank <= 5) AS a, count(*) FILTER (rank <= 10) AS bb, count(*) FILTER (rank <= 50) AS cc FROM gt LEFT JOIN l1 USING ({_P}) GROUP BY gt.user_id) " + " UNION ALL ".join(
        f"SELECT {k} AS k, {_r(f'avg({x} / n::DOUBLE)')} AS recall, count(*) AS users FROM u" for k, x in ((5, "a"), (10, "bb"), (50, "cc"))),
    "M9_random_recall": "WITH " + _WIDE + ", gt AS (SELECT DISTINCT user_id, live_id, streamer_id FROM imp WHERE is_click = 1), pl AS (SELECT live_id, streamer_id, row_number() OVER (ORDER BY md5(live_id || '|' || streamer_id || '|42'), live_id, streamer_id) - 1 AS place FROM pool), n AS (SELECT count(*) AS n FROM pool), dr AS (SELECT user_id, j, (('0x' || substr(md5(user_id || '|' || j || '|42'), 1, 8))::BIGINT) % n AS place FROM (SELECT DISTINCT user_id FROM gt), (SELECT unnest(range(1, 465)) AS j), n), fd AS (SELECT user_id, place, min(j) AS j FROM dr GROUP BY ALL), rk AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY j) AS rank FROM fd QUALIFY rank <= 100), h AS (SELECT gt.user_id, rank FROM gt LEFT JOIN (SELECT rk.user_id, rank, live_id, streamer_id FROM rk JOIN pl USING (place)) r USING (user_id, live_id, streamer_id)), u AS (SELECT user_id, count(*) AS n, count(*) FILTER (rank <= 10) AS a, count(*) FILTER (rank <= 50) AS bb, count(*) FILTER (rank <= 100) AS cc FROM h GROUP BY user_id) " + " UNION ALL ".join(
        f"SELECT {k} AS k, {_r(f'avg({x} / n::DOUBLE)')} AS recall, count(*) AS users FROM u" for k, x in ((10, "a"), (50, "bb"), (100, "cc"))),
    "M10_retrieval_report": f"WITH {_WIDE}, p AS (SELECT DISTINCT live_id, streamer_id, 1 AS inp FROM imp WHERE {b.split_sql('ts')} = 'train'), m AS (SELECT imp.*, inp FROM imp LEFT JOIN p USING (live_id, streamer_id)) SELECT count(*) AS rows, count(*) FILTER (is_click = 1) AS positives, count(DISTINCT user_id) AS unique_users, count(DISTINCT user_id) FILTER (is_click = 1) AS users_with_positives, count(DISTINCT (live_id, streamer_id)) FILTER (inp = 1) AS pool_size, count(DISTINCT user_id) FILTER (is_click = 1 AND inp = 1) AS gt_users, count(DISTINCT (live_id, streamer_id)) FILTER (is_click = 1 AND inp = 1) AS pos_pool_intersect, {_r('count(*) FILTER (is_click = 1 AND inp = 1) / (count(*) FILTER (is_click = 1))::DOUBLE')} AS pos_pool_match_rate FROM m",
    "M19_sweep": f"{_HEAD} {_GRID}",
    "T13_leaderboard": f"{_HEAD}, ok AS ({_GRID}), long AS (" + " UNION ALL ".join(
        f"SELECT topk, multi_interest_k, '{m}' AS metric, \"{m}\" AS value FROM ok WHERE \"{m}\" IS NOT NULL" for m in ("recall_mean", "pair_overlap_rate", "auc_mean", "ndcg@10_is_click")
    ) + ") SELECT metric, value, topk, multi_interest_k, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, topk, multi_interest_k) AS INTEGER) AS place FROM long QUALIFY place <= 5",
    "T13_summary": f"{_HEAD}, ok AS ({_GRID}) SELECT count(*) + 3 AS num_runs_total, count(*) AS num_runs_ok, arg_max(auc_mean, (auc_mean, -topk, -multi_interest_k)) AS best_auc_mean, arg_max(topk, (auc_mean, -topk, -multi_interest_k)) AS best_topk, arg_max(multi_interest_k, (auc_mean, -topk, -multi_interest_k)) AS best_multi_interest_k FROM ok",
    "M_match_report": f"WITH {SCORED_LABELS}, m AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY {_P} ORDER BY t_us DESC, event_id) = 1), a AS ({_plain(_auc_sql(TASKS, 'm'))}), e AS (SELECT avg(pow(watch_live_time_log - score_watch_live_time_log, 2)) AS x FROM m) SELECT metric, {_r('value')} AS value FROM a UNION ALL SELECT 'auc_mean', {_r('avg(value)')} FROM a UNION ALL SELECT 'mse_watch_live_time_log', {_r('x')} FROM e UNION ALL SELECT 'rmse_watch_live_time_log', {_r('sqrt(x)')} FROM e UNION ALL " + " UNION ALL ".join(
        _list_sql("m", y, sc, (10,), ("ndcg", "precision"), f"_{t}", "live_id, streamer_id") for t, (y, sc) in TASKS.items() if t != "watch_greater_30s"),
    "M1_auc": f"WITH {SCORED_LABELS} {_auc_sql(TASKS, 'scored')}",
    "M1_auc_documents": "WITH d AS (SELECT * FROM labels JOIN documents USING (doc_id)) " + _auc_sql({"quality": ("quality", "n_chars"), "toxic": ("toxic", "n_chars")}, "d"),
    "M2_auc_mean": f"WITH {SCORED_LABELS}, a AS ({_plain(_auc_sql(TASKS, 'scored'))}) SELECT 'auc_mean' AS metric, {_r('avg(value)')} AS value FROM a",
    "M3_precision": f"WITH {SCORED} {_list_sql('scored', 'is_click', 'score_ctr', (1, 3, 5, 10), ('precision',))}",
    "M4_ndcg": f"WITH {SCORED} {_list_sql('scored', 'watch_greater_30s', 'score_watch_greater_30s', (5, 10, 50), ('ndcg',))}",
    "M5_list_metrics": f"WITH {SCORED} {_list_sql('scored', 'is_click', 'score_ctr', (5, 10, 20), _ALL, '_is_click')}",
    "M11_regression": f"WITH {SCORED}, e AS (SELECT avg(pow(watch_live_time_log - score_watch_live_time_log, 2)) AS m FROM scored) SELECT 'mse_watch_live_time_log' AS metric, {_r('m')} AS value FROM e UNION ALL SELECT 'rmse_watch_live_time_log', {_r('sqrt(m)')} FROM e",
    "M12_loss": f"WITH {SCORED_LABELS} SELECT 'loss' AS metric, {_r('avg(' + _bce('is_click', 'score_ctr') + ' + 0.5 * ' + _bce('watch_greater_30s', 'score_watch_greater_30s') + ' + 2 * ' + _bce('is_like', 'score_like') + ' + ' + _HUB + ')')} AS value FROM scored UNION ALL SELECT 'bce', {_r('avg(' + _bce('is_click', 'score_ctr') + ')')} FROM scored",
    "M18_compact": f"WITH {SCORED_LABELS} {_auc_sql(TASKS, 'scored')} UNION ALL {_list_sql('scored', 'is_click', 'score_ctr', (10,), ('precision',), '_is_click')}",
    "T8_prefilter": f"WITH {_LIST} SELECT {_P}, CAST(rank AS INTEGER) AS rank, rel AS relevance_score FROM listed",
    "T9_category_similarity": _profile_sql(_SIM_CAT),
    "T10_cosine_similarity": _profile_sql(_SIM_NUM),
    "T11_blended_similarity": _profile_sql(_SIM_BOTH),
    "T12_mmr": _mmr_sql("0.7", _SIM_CAT),
    "T12_mmr_relevance_only": _mmr_sql("1.0", _SIM_CAT),
    "T12_mmr_blended": _mmr_sql("0.5", _SIM_BOTH),
    "M14_diversity": f"WITH {_LIST} {_div_sql('listed', 5)}",
    "M15_freshness": f"WITH {_LIST} {_fresh_sql('listed', 5)}",
    "M16_popularity": f"WITH {_LIST} {_pop_sql('listed', 5)}",
    "M17_delta": f"WITH {_LIST}, x AS ({_plain(_div_sql('listed', 5))}), y AS ({_plain(_div_sql('listed', 10))}) SELECT metric, {_r('x.value')} AS before, {_r('y.value')} AS after, {_r('y.value - x.value')} AS delta FROM x FULL JOIN y USING (metric)",
    "T12_rerank_report": _report_sql(),
    "R1_freshness": f"WITH {b.IMP} SELECT event_id, {_r(_AGE)} AS weight FROM imp",
    "R2_weak_weight": f"WITH {b.IMP} SELECT event_id, {_r(f'{_AGE} * CASE WHEN is_click = 1 AND watch_live_time < 30 THEN 0.3 ELSE 1 END')} AS weight FROM imp",
    "R2_weak_drop": f"WITH {b.IMP} SELECT event_id FROM imp WHERE NOT (is_click = 1 AND watch_live_time < 30)",
    "R3_positives": f"WITH {b.IMP} SELECT event_id FROM imp WHERE is_click = 1",
    "R4_cap": f"WITH {b.IMP} SELECT event_id, user_id FROM imp WHERE is_click = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_MD.format(x='event_id')}, event_id) <= 4",
    "R4_cap_report": f"WITH {b.IMP}, u AS (SELECT count(*) AS n FROM imp WHERE is_click = 1 GROUP BY user_id) SELECT CAST(sum(greatest(n - 4, 0)) AS BIGINT) AS dropped, CAST(sum(least(n, 4)) AS BIGINT) AS kept FROM u",
    "R5_rebalance": f"""WITH n AS (SELECT count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM labels),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {_MD.format(x='doc_id')}, doc_id) - 1 AS place FROM labels WHERE toxic IN (0, 1)),
t AS (SELECT r.*, CASE WHEN toxic = 1 THEN p ELSE n END AS size,
             CASE WHEN p = 0 OR n = 0 THEN p + n WHEN toxic = 1 THEN (p + n + 1) // 2 ELSE (p + n) // 2 END AS total FROM r, n),
k AS (SELECT doc_id, CAST((place + 1) * total // size - place * total // size AS INTEGER) AS copies FROM t)
SELECT doc_id, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM k WHERE copies > 0""",
    "R6_hard_negatives": f"""WITH {_WIDE},
pr AS (SELECT {_P}, max(is_click) AS is_click FROM imp GROUP BY ALL),
sc AS (SELECT pr.*, list_dot_product(q1.v, iv.v) AS sim FROM pr JOIN q1 USING (user_id) JOIN iv USING (live_id, streamer_id) WHERE is_click = 1),
np AS (SELECT live_id, streamer_id, v FROM (SELECT DISTINCT live_id, streamer_id FROM pr WHERE is_click <> 1) JOIN iv USING (live_id, streamer_id)),
hn AS (
  SELECT u.user_id, np.live_id AS neg_live_id, np.streamer_id AS neg_streamer_id, list_dot_product(q1.v, np.v) AS neg_sim
  FROM (SELECT DISTINCT user_id FROM sc) u JOIN q1 USING (user_id) CROSS JOIN np
  WHERE (u.user_id, np.live_id, np.streamer_id) NOT IN (SELECT ({_P}) FROM pr WHERE is_click = 1)
  QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY neg_sim DESC, np.live_id, np.streamer_id) = 1)
SELECT user_id, live_id, streamer_id, {_r('sim')} AS pos_sim, neg_live_id, neg_streamer_id, {_r('neg_sim')} AS neg_sim,
       {_r('greatest(0.2 + (1 - sim) - (1 - neg_sim), 0)')} AS loss
FROM sc LEFT JOIN hn USING (user_id)""",
    "R8_guard": f"WITH {b.IMP} SELECT event_id, 'test' AS split FROM imp WHERE {b.split_sql('ts')} = 'test'",
    "R9_optimum": f"WITH {b.IMP}, t AS (SELECT count(*) AS rows FROM imp WHERE {b.split_sql('ts')} = 'train') SELECT head, rows, true AS at_optimum FROM t, (VALUES " + ", ".join(f"('{y}')" for y in [*HEADS, REG[0]]) + ") h(head)",
    "R10_solved": "SELECT count(DISTINCT o_custkey) AS users, count(DISTINCT o_custkey) AS solved FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "R9_calibration": f"WITH {b.IMP}, t AS (SELECT count(*) AS rows FROM imp WHERE {b.split_sql('ts')} = 'train') SELECT head, rows, true AS calibrated, true AS mean_of_heads FROM t, (VALUES " + ", ".join(f"('{y}')" for y in HEADS) + ") h(head)",
    "R10_factors": "SELECT DISTINCT o_custkey AS id, 8 AS width, 'user' AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_partkey, 8, 'item' FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ST1_stream_dedup": f"WITH {b.IMP} SELECT live_id, streamer_id, user_id, is_click, event_id FROM imp QUALIFY row_number() OVER (PARTITION BY live_id, streamer_id, user_id ORDER BY is_click DESC, CASE WHEN is_click = 1 THEN t_us ELSE -t_us END NULLS LAST, event_id) = 1",
}
