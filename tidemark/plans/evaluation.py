"""Two-stage evaluation: hand-off, grid of list lengths, leaderboard, reranking report."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import weighted_relevance
from tidemark.functions.roles import BINARY_TASKS
from tidemark.operators.dedup import best_row, latest_row
from tidemark.operators.metrics import (
    PAIR,
    auc,
    diversity,
    evaluate_ranked,
    freshness,
    list_metrics,
    mean_metric,
    metric_delta,
    popularity,
    regression_errors,
)
from tidemark.operators.ranking import top_k
from tidemark.operators.rerank import mmr, prefilter
from tidemark.operators.skew import global_running
from tidemark.session import materialise

ITEM_KEYS = ["live_id", "streamer_id"]


def rank_candidates(topk: DataFrame, ranking_rows: DataFrame, k: int) -> DataFrame:
    """Candidates that have a ranking row, with the latest such row."""
    pairs = topk.where(F.col("rank") <= k).select(
        *PAIR, F.col("rank").alias("stage1_rank"), F.col("score").alias("stage1_score")
    )
    return pairs.join(latest_row(ranking_rows, PAIR, "t_us", "event_id"), PAIR)


def join_labels(scored: DataFrame, labelled: DataFrame, item_columns: Sequence[str]) -> DataFrame:
    """Scored candidates with the latest label per pair and the latest item features."""
    t = [F.col("t_us").isNull(), -F.col("t_us"), F.col("event_id")]
    labels = best_row(labelled.select(*PAIR, *BINARY_TASKS, "t_us", "event_id"), PAIR, t).drop("t_us", "event_id")
    features = best_row(labelled.select(*ITEM_KEYS, *item_columns, "t_us", "event_id"), ITEM_KEYS, t)
    return scored.join(labels, PAIR).join(features.drop("t_us", "event_id"), ITEM_KEYS, "left")


def sweep(
    candidates: Mapping[int, DataFrame],
    ranking_rows: DataFrame,
    truth: DataFrame,
    ks: Sequence[int],
    tasks: Mapping[str, tuple[str, str]],
    main: str = "is_click",
    at: int = 10,
) -> DataFrame:
    """One row per (topk, interests): recall, overlap, and ranking quality of the matched candidates.

    ``candidates`` maps the number of interests to one list of max(ks) items
    per user; ``tasks`` a task to its (label, score) in ``ranking_rows``, whose
    latest row per pair counts.  A candidate of rank r counts for every K >= r,
    so the whole grid comes from one pass over all lists together.  Precision
    and NDCG at ``at`` are those of the ``main`` task, averaged over users.
    """
    cell = ["topk", "multi_interest_k"]
    scored = [c for pair in tasks.values() for c in pair]
    ranked = latest_row(ranking_rows, PAIR, "t_us", "event_id").select(*PAIR, *dict.fromkeys(scored), F.lit(1).alias("_row"))
    gt = truth.select(*PAIR).distinct()
    users = gt.groupBy("user_id").agg(F.count(F.lit(1)).alias("_gt"))
    user_count = users.agg(F.count(F.lit(1))).scalar()
    lists = None
    for interests, topk in candidates.items():
        part = topk.select(*PAIR, "rank", F.lit(interests).alias("multi_interest_k"))
        lists = part if lists is None else lists.unionByName(part)
    marked = lists.join(gt.withColumn("_hit", F.lit(1)), PAIR, "left").join(ranked, PAIR, "left")
    grid = F.array(*[F.lit(k) for k in sorted(ks)])
    cells = materialise(marked).withColumn("topk", F.explode(F.filter(grid, lambda k: k >= F.col("rank"))))
    per_user = cells.groupBy(*cell, "user_id").agg(
        F.count(F.lit(1)).alias("_pairs"), F.count("_row").alias("_matched"), F.count("_hit").alias("_h")
    )
    counts = (
        per_user.join(users, "user_id", "left")
        .groupBy(*cell)
        .agg(
            F.sum("_pairs").alias("candidate_pairs"),
            F.sum("_matched").alias("matched_pairs"),
            # Users without any hit add 0 to the mean: divide by all users with ground truth.
            (F.coalesce(F.sum(F.col("_h") / F.col("_gt")), F.lit(0.0)) / user_count).alias("recall_mean"),
        )
    )
    matched = cells.where(F.col("_row").isNotNull())
    aucs = _cell_aucs(matched, cell, tasks)
    label, score = tasks[main]
    y = F.col(label).cast("double")
    best = top_k(matched, [*cell, "user_id"], [F.col(score).desc(), *ITEM_KEYS], at)
    lists_of = best.groupBy(*cell, "user_id").agg(
        F.avg(y).alias("_precision"), F.sum(y / F.log2(F.col("rank") + 1.0)).alias("_dcg")
    )
    positives = matched.groupBy(*cell, "user_id").agg(F.sum(y).cast("int").alias("_positives"))
    ideal = F.lit(0.0)
    for place in range(at, 0, -1):
        gain = sum(1.0 / math.log2(i + 1) for i in range(1, place + 1))
        ideal = F.when(F.least(F.col("_positives"), F.lit(at)) == place, F.lit(gain)).otherwise(ideal)
    quality = (
        lists_of.join(positives, [*cell, "user_id"])
        .groupBy(*cell)
        .agg(
            F.avg("_precision").alias(f"precision@{at}_{main}"),
            F.avg(F.when(F.col("_positives") > 0, F.col("_dcg") / ideal)).alias(f"ndcg@{at}_{main}"),
        )
    )
    return (
        counts.join(aucs, cell, "left")
        .join(quality, cell, "left")
        .select(
            *cell,
            "recall_mean",
            "candidate_pairs",
            "matched_pairs",
            (F.col("matched_pairs") / F.col("candidate_pairs")).alias("pair_overlap_rate"),
            *[f"auc_{t}" for t in tasks],
            "auc_mean",
            f"precision@{at}_{main}",
            f"ndcg@{at}_{main}",
        )
    )


def sweep_runs(
    candidates: Mapping[int, DataFrame], ranking_rows: DataFrame, truth: DataFrame, ks: Sequence[int], tasks: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """The whole grid of a sweep with the status of each run.

    A run without any candidate, or without a candidate that has a ranked row,
    has nothing to be measured on and has failed; its row stays.
    """
    found = sweep(candidates, ranking_rows, truth, ks, tasks)
    grid = [(k, i) for i in candidates for k in sorted(ks)]
    cells = found.sparkSession.createDataFrame(grid, "topk int, multi_interest_k int")
    status = (
        F.when(F.col("candidate_pairs").isNull(), F.lit("failed_no_candidates"))
        .when(F.col("matched_pairs") == 0, F.lit("failed_no_matches"))
        .otherwise("ok")
    )
    return cells.join(found, ["topk", "multi_interest_k"], "left").withColumn("status", status)


def _cell_aucs(matched: DataFrame, cell: Sequence[str], tasks: Mapping[str, tuple[str, str]]) -> DataFrame:
    """AUC of every task in every cell, ties averaged, and the mean of those that exist."""
    triples = F.array(
        *[
            F.struct(F.lit(t).alias("task"), F.col(y).cast("int").alias("y"), F.col(s).cast("double").alias("score"))
            for t, (y, s) in tasks.items()
        ]
    )
    rows = matched.select(*cell, F.explode(triples).alias("r")).where(F.col("r.score").isNotNull())
    scores = rows.groupBy(*cell, "r.task", "r.score").agg(
        F.count_if(F.col("r.y") == 1).alias("pos"), F.count_if(F.col("r.y") == 0).alias("neg")
    )
    group = [*cell, "task"]
    placed = global_running(scores, [*group, "score"], {"neg": F.col("neg")})
    areas = placed.groupBy(*group).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("neg_before").alias("start"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("area"),
    )
    pairs = F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))
    value = F.try_divide(F.col("area") - F.col("start").cast("double") * F.col("p"), pairs)
    return areas.groupBy(*cell).agg(
        *[F.max(F.when(F.col("task") == t, value)).alias(f"auc_{t}") for t in tasks], F.avg(value).alias("auc_mean")
    )


def run_summary(runs: DataFrame, metric: str = "auc_mean") -> DataFrame:
    """Runs in all, runs that did not fail, and the best of those by one metric."""
    ok = ~F.coalesce(F.col("status").startswith("failed_"), F.lit(False))
    good = F.when(ok & F.col(metric).isNotNull(), F.struct(metric, -F.col("topk"), -F.col("multi_interest_k")))
    row = runs.agg(
        F.count(F.lit(1)).alias("num_runs_total"), F.count_if(ok).alias("num_runs_ok"), F.max(good).alias("_best")
    )
    return row.select(
        "num_runs_total",
        "num_runs_ok",
        F.col(f"_best.{metric}").alias(f"best_{metric}"),
        (-F.col("_best.col2")).alias("best_topk"),
        (-F.col("_best.col3")).alias("best_multi_interest_k"),
    )


def match_report(
    matched: DataFrame,
    tasks: Mapping[str, tuple[str, str]],
    regression: tuple[str, str],
    ks: Sequence[int] = (10,),
    listed: Sequence[str] = ("is_click", "is_like"),
) -> DataFrame:
    """Ranking metrics of the candidates that have labels, as (metric, value) rows.

    AUC of every task and their mean, precision and NDCG of the ``listed``
    tasks, errors of the regression head.
    """
    matched = materialise(matched)
    aucs = materialise(auc(matched, tasks))
    out = aucs.unionByName(mean_metric(aucs)).unionByName(regression_errors(matched, *regression))
    for task in listed:
        label, score = tasks[task]
        out = out.unionByName(list_metrics(matched, label, score, ks, suffix=f"_{task}", kinds=("ndcg", "precision")))
    return out


def leaderboard(runs: DataFrame, metrics: Sequence[str], best: int = 5) -> DataFrame:
    """Best runs per metric; failed runs and missing values leave, ties to smaller topk, then interests."""
    ok = runs.where(~F.coalesce(F.col("status").startswith("failed_"), F.lit(False))) if "status" in runs.columns else runs
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    long = (
        ok.select("topk", "multi_interest_k", F.explode(pairs).alias("s"))
        .select("s.metric", "s.value", "topk", "multi_interest_k")
        .where(F.col("value").isNotNull())
    )
    return top_k(long, ["metric"], [F.col("value").desc(), "topk", "multi_interest_k"], best, "place")


def rerank_report(
    merged: DataFrame,
    weights: Mapping[str, float],
    categories: Sequence[str],
    numbers: Sequence[str] = (),
    trade_off: float = 0.7,
    pool: int = 100,
    top_n: int = 20,
    ks: Sequence[int] = (5, 10, 20),
    age_hours: str | None = None,
    popular: str | None = None,
) -> DataFrame:
    """Metrics of the relevance order and of the reranked order, and their difference."""
    scored = merged.withColumn("relevance_score", weighted_relevance(weights))
    listed = materialise(prefilter(scored, pool))
    before = listed.where(F.col("rank") <= top_n).withColumn("list_score", F.col("relevance_score"))
    after = materialise(mmr(listed, trade_off, top_n, categories, numbers)).withColumn("list_score", F.col("mmr_score"))

    def measure(df: DataFrame) -> DataFrame:
        out = evaluate_ranked(df, "list_score", BINARY_TASKS, ks).unionByName(diversity(df, top_n))
        if age_hours:
            out = out.unionByName(freshness(df, top_n, age_hours))
        if popular:
            out = out.unionByName(popularity(df, top_n, popular))
        return out

    return metric_delta(measure(before), measure(after))
