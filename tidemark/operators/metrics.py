"""Ranking metrics and evaluation diagnostics.

Lists are ordered by score, then item keys.  Long results are
``(metric, value)`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import LN2, clip
from tidemark.functions.roles import COMPACT_METRICS
from tidemark.operators.ranking import top_k
from tidemark.operators.skew import global_running

PAIR = ["user_id", "live_id", "streamer_id"]
TIES = ["live_id", "streamer_id"]


def long_metrics(row: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One wide row to ``(metric, value)`` rows."""
    columns = list(columns or row.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return row.select(F.explode(pairs).alias("s")).select("s.metric", "s.value")


def auc(df: DataFrame, tasks: Mapping[str, tuple[str, str]]) -> DataFrame:
    """AUC per task with averaged ties, null when a class is absent (M1).

    ``tasks`` maps a name to (label, score).  Equal scores are counted first;
    the running number of negatives is taken over (task, score) cells of all
    tasks together, split into ranges.
    """
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("task"), F.col(y).cast("int").alias("y"), F.col(s).cast("double").alias("score"))
            for t, (y, s) in tasks.items()
        ]
    )
    cells = (
        df.select(F.explode(rows).alias("r"))
        .where(F.col("r.score").isNotNull())
        .groupBy("r.task", "r.score")
        .agg(F.count_if(F.col("r.y") == 1).alias("pos"), F.count_if(F.col("r.y") == 0).alias("neg"))
    )
    placed = global_running(cells, ["task", "score"], {"neg": F.col("neg")})
    # Negatives of earlier tasks are in the running count too: take the task's own start away.
    per_task = placed.groupBy("task").agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.min("neg_before").alias("start"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("area"),
    )
    pairs = F.col("p").cast("double") * F.col("n")
    return per_task.select(
        F.concat(F.lit("auc_"), "task").alias("metric"),
        F.try_divide(F.col("area") - F.col("start").cast("double") * F.col("p"), F.nullif(pairs, F.lit(0.0))).alias(
            "value"
        ),
    )


def mean_metric(metrics: DataFrame, name: str = "auc_mean") -> DataFrame:
    """Mean of the available values (M2)."""
    return metrics.agg(F.avg("value").alias("value")).select(F.lit(name).alias("metric"), "value")


def _gain(label: Column, rank: Column) -> Column:
    return label / F.log2(rank + F.lit(1.0))


def list_metrics(
    df: DataFrame,
    label: str,
    score: str,
    ks: Sequence[int],
    user: str = "user_id",
    ties: Sequence[str] = TIES,
    suffix: str = "",
    kinds: Sequence[str] = ("ndcg", "precision", "recall"),
) -> DataFrame:
    """NDCG, precision and recall@K per user, averaged (M3, M4, M5).

    Precision divides by min(K, list length) and counts every user; NDCG skips
    users without a positive, recall those with none in the list.  Only the
    top max(K) rows of a user by score, and by label, are shuffled.
    """
    longest = max(ks)
    y = F.col(label).cast("double")
    rows = df.select(user, *ties, y.alias("_y"), F.col(score).alias("_s"))
    top = top_k(rows, [user], [F.col("_s").desc(), *ties], longest)
    at = lambda k, e: F.sum(F.when(F.col("rank") <= k, e))
    served = top.groupBy(user).agg(
        *[at(k, F.col("_y")).alias(f"hit{k}") for k in ks],
        *[at(k, F.lit(1)).alias(f"len{k}") for k in ks],
        *[at(k, _gain(F.col("_y"), F.col("rank"))).alias(f"dcg{k}") for k in ks],
    )
    if "ndcg" in kinds:
        ideal = top_k(rows, [user], [F.col("_y").desc(), *ties], longest)
        served = served.join(
            ideal.groupBy(user).agg(*[at(k, _gain(F.col("_y"), F.col("rank"))).alias(f"best{k}") for k in ks]), user
        )
    if "recall" in kinds:
        served = served.join(rows.groupBy(user).agg(F.sum("_y").alias("all")), user)
    values = []
    for k in ks:
        if "ndcg" in kinds:
            value = F.when(F.col(f"best{k}") > 0, F.col(f"dcg{k}") / F.col(f"best{k}"))
            values.append(F.avg(value).alias(f"ndcg@{k}{suffix}"))
        if "precision" in kinds:
            values.append(F.avg(F.col(f"hit{k}") / F.col(f"len{k}")).alias(f"precision@{k}{suffix}"))
        if "recall" in kinds:
            value = F.when(F.col("all") > 0, F.col(f"hit{k}") / F.col("all"))
            values.append(F.avg(value).alias(f"recall@{k}{suffix}"))
    return long_metrics(served.agg(*values))


def precision_at_k(df: DataFrame, label: str, score: str, ks: Sequence[int], **options) -> DataFrame:
    return list_metrics(df, label, score, ks, kinds=("precision",), **options)


def ndcg_at_k(df: DataFrame, label: str, score: str, ks: Sequence[int], **options) -> DataFrame:
    return list_metrics(df, label, score, ks, kinds=("ndcg",), **options)


def evaluate_ranked(
    df: DataFrame, score: str, tasks: Sequence[str], ks: Sequence[int], user: str = "user_id", ties: Sequence[str] = TIES
) -> DataFrame:
    """The list metrics of several 0/1 tasks from one order per user (M5).

    One exchange by user: places, hits, gains and totals of all tasks and list
    lengths are conditional sums over the same rows.
    """
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.col(score).desc(), *ties))
    rows = df.select(user, *ties, *[F.col(t).cast("double").alias(f"_y_{t}") for t in tasks], F.col(score).alias(score))
    placed = rows.withColumn("_place", place)
    within = lambda k, e: F.sum(F.when(F.col("_place") <= k, e))
    sums = [within(k, F.lit(1)).alias(f"len{k}") for k in ks]
    for t in tasks:
        y = F.col(f"_y_{t}")
        sums.append(F.sum(y).alias(f"all_{t}"))
        sums += [within(k, y).alias(f"hit{k}_{t}") for k in ks]
        sums += [within(k, _gain(y, F.col("_place"))).alias(f"dcg{k}_{t}") for k in ks]
    per_user = placed.groupBy(user).agg(*sums)
    best = F.array(*[F.lit(sum(1.0 / math.log2(i + 1) for i in range(1, n + 1))) for n in range(1, max(ks) + 1)])
    values = []
    for t in tasks:
        every = F.col(f"all_{t}")
        for k in ks:
            ideal = F.get(best, F.least(every, F.lit(float(k))).cast("int") - 1)
            values += [
                F.avg(F.when(every > 0, F.col(f"dcg{k}_{t}") / ideal)).alias(f"ndcg@{k}_{t}"),
                F.avg(F.col(f"hit{k}_{t}") / F.col(f"len{k}")).alias(f"precision@{k}_{t}"),
                F.avg(F.when(every > 0, F.col(f"hit{k}_{t}") / every)).alias(f"recall@{k}_{t}"),
            ]
    return long_metrics(per_user.agg(*values))


def recall_by_user(truth: DataFrame, ranked: DataFrame, k: int, keys: Sequence[str] = PAIR) -> DataFrame:
    """Truth, hits and recall@K per user with ground truth."""
    gt = truth.select(*keys).distinct()
    hits = gt.join(ranked.where(F.col("rank") <= k).select(*keys).distinct(), list(keys), "left_semi")
    counted = gt.groupBy("user_id").agg(F.count(F.lit(1)).alias("gt_count"))
    found = hits.groupBy("user_id").agg(F.count(F.lit(1)).alias("hit_count"))
    return counted.join(found, "user_id", "left").select(
        "user_id",
        "gt_count",
        F.coalesce("hit_count", F.lit(0)).alias("hit_count"),
        (F.coalesce("hit_count", F.lit(0)) / F.col("gt_count")).alias("recall"),
    )


def live_recall_by_user(candidates: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Positives, hits and recall@K on (user, live) for every user with a positive (M7)."""
    keys = ["user_id", "live_id"]
    positives = pairs.where(F.col("is_positive") == 1).select(*keys).distinct().withColumn("_pos", F.lit(1))
    listed = candidates.where(F.col("rank") <= k).select(*keys).distinct().withColumn("_hit", F.lit(1))
    hit = positives.join(listed, keys, "left")
    per_user = hit.groupBy("user_id").agg(F.sum("_pos").alias("num_pos"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("num_hit"))
    return per_user.withColumn("recall", F.when(F.col("num_pos") > 0, F.col("num_hit") / F.col("num_pos")))


def regression_errors(df: DataFrame, label: str, prediction: str, name: str = "watch_live_time_log") -> DataFrame:
    """MSE and RMSE with the residual clipped to 1e6."""
    d = clip(F.col(label).cast("double") - F.col(prediction).cast("double"), -1e6, 1e6)
    row = df.agg(F.avg(d * d).alias(f"mse_{name}")).withColumn(f"rmse_{name}", F.sqrt(f"mse_{name}"))
    return long_metrics(row)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def multitask_loss(
    df: DataFrame,
    binary: Mapping[str, tuple[str, str, float]],
    regression: tuple[str, str, float] | None = None,
    squared: bool = False,
    bound: float = 8.0,
) -> DataFrame:
    """Weighted mean losses of a prediction table.

    ``binary`` maps a task to (label, logit, weight); ``regression`` is
    (label, prediction, weight) with the prediction clamped to ``bound``.
    Rows whose loss is not finite are left out.
    """
    terms = []
    for y, z, weight in binary.values():
        logit = F.col(z).cast("double")
        softplus = F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
        terms.append(F.lit(weight) * (softplus - F.col(y).cast("double") * logit))
    if regression is not None:
        y, p, weight = regression
        d = clip(F.col(p).cast("double"), -bound, bound) - F.col(y).cast("double")
        size = F.abs(d)
        error = d * d if squared else F.when(size < 1, d * d * 0.5).otherwise(size - 0.5)
        terms.append(F.lit(weight) * error)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return long_metrics(df.agg(F.coalesce(F.avg(_finite(total)), F.lit(0.0)).alias("loss")))


def _key_overlap(cand: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    left = cand.select(*keys).distinct().withColumn("_l", F.lit(1))
    right = other.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = left.join(right, list(keys), "full")
    return both.agg(
        F.count("_l").alias("candidate_count"),
        F.count("_r").alias("other_count"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("overlap_count"),
    ).select(
        F.lit(name).alias("level"),
        "*",
        (F.col("overlap_count") / F.greatest(F.col("candidate_count"), F.lit(1))).alias("overlap_rate"),
    )


OVERLAP_LEVELS = {"users": ["user_id"], "live_ids": ["live_id"], "streamers": ["streamer_id"], "pairs": PAIR}


def overlap_report(cand: DataFrame, other: DataFrame) -> DataFrame:
    """Unique, shared and covered keys per level."""
    out = None
    for name, keys in OVERLAP_LEVELS.items():
        part = _key_overlap(cand, other, keys, name)
        out = part if out is None else out.unionByName(part)
    return out


def missing_examples(cand: DataFrame, other: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` candidate keys absent on the other side."""
    absent = cand.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti")
    return absent.orderBy(*keys).limit(n)


def shared_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key-set intersection."""
    return a.select(*keys).intersect(b.select(*keys))


def diversity(ranked: DataFrame, n: int) -> DataFrame:
    """Unique streamers and live types per user and share of the catalogue shown."""
    top = ranked.where(F.col("rank") <= n)
    per_user = top.groupBy("user_id").agg(
        F.count_distinct("streamer_id").alias("s"), F.count_distinct("live_type").alias("t")
    )
    means = per_user.agg(F.avg("s").alias("ms"), F.avg("t").alias("mt"))
    shown = F.col("rank") <= n
    cover = ranked.agg(
        F.try_divide(F.count_distinct(F.when(shown, F.col("streamer_id"))), F.count_distinct("streamer_id")).alias("cs"),
        F.try_divide(F.count_distinct(F.when(shown, F.col("live_type"))), F.count_distinct("live_type")).alias("ct"),
    )
    names = {
        "ms": "diversity_unique_streamers_mean@N", "mt": "diversity_unique_live_types_mean@N",
        "cs": "diversity_streamer_coverage@N", "ct": "diversity_live_type_coverage@N",
    }
    parts = [long_metrics(d.withColumnsRenamed({k: v for k, v in names.items() if k in d.columns})) for d in (means, cover)]
    return parts[0].unionByName(parts[1])


def freshness(ranked: DataFrame, n: int, age_hours: str, half_life: float = 6.0) -> DataFrame:
    """Mean age and mean half-life score."""
    age = F.col(age_hours).cast("double")
    score = F.exp(-clip(age, 0.0) * F.lit(LN2 / max(half_life, 1e-6)))
    return long_metrics(
        ranked.where(F.col("rank") <= n).agg(
            F.avg(age).alias("freshness_avg_age@N"), F.avg(score).alias("freshness_score_mean@N")
        )
    )


def popularity(ranked: DataFrame, n: int, column: str) -> DataFrame:
    """Mean raw and min-max normalised popularity (M16); bounds over the full list."""
    p = F.col(column).cast("double")
    row = ranked.agg(
        F.avg(F.when(F.col("rank") <= n, p)).alias("popularity_mean_raw@N"), F.min(p).alias("lo"), F.max(p).alias("hi")
    )
    norm = F.when(
        F.col("hi") > F.col("lo"), (F.col("`popularity_mean_raw@N`") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    )
    return long_metrics(
        row.withColumn("popularity_mean_norm@N", norm), ["popularity_mean_raw@N", "popularity_mean_norm@N"]
    )


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """After minus before per metric, null where either is missing."""
    left = before.select("metric", F.col("value").alias("before"))
    right = after.select("metric", F.col("value").alias("after"))
    return left.join(right, "metric", "full").withColumn("delta", F.col("after") - F.col("before"))


def compact(metrics: DataFrame, names: Sequence[str] = COMPACT_METRICS) -> DataFrame:
    """A fixed subset of metrics."""
    return metrics.where(F.col("metric").isin(*names))
