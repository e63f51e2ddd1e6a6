"""Training-set shaping."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import LN2, hash_fraction, to_number
from tidemark.operators.ranking import top_k
from tidemark.operators.retrieval import nearest_items
from tidemark.operators.skew import dense_index
from tidemark.session import materialise, shared_folder

#: Ratings in one block of the factor fit, and the least number of blocks on either side.
BLOCK_RATINGS, LEAST_BLOCKS = 1 << 21, 10


def freshness_weight(df: DataFrame, half_life_hours: float, time_us: str = "t_us", out: str = "weight") -> DataFrame:
    """exp(-ln 2 * age / half-life) against the latest row; missing time 0."""
    latest = df.agg(F.max(time_us).alias("t")).first()["t"]
    age = (F.lit(latest) - F.col(time_us)) / F.lit(3.6e9)
    return df.withColumn(out, F.coalesce(F.exp(-age * F.lit(LN2 / max(half_life_hours, 1e-6))), F.lit(0.0)))


def is_weak_positive(label: str = "is_click", threshold: float = 30.0) -> Column:
    return F.coalesce((to_number("watch_live_time") < threshold) & (F.col(label) == 1), F.lit(False))


def weigh_weak_positives(df: DataFrame, weight: float = 0.5, label: str = "is_click", out: str = "weight") -> DataFrame:
    """Short watches count less as positives (R2, cross-entropy)."""
    factor = F.when(is_weak_positive(label), F.lit(min(max(weight, 0.0), 1.0))).otherwise(F.lit(1.0))
    base = F.col(out) if out in df.columns else F.lit(1.0)
    return df.withColumn(out, base * factor)


def drop_weak_positives(df: DataFrame, label: str = "is_click") -> DataFrame:
    """Short watches leave (R2, other losses)."""
    return df.where(~is_weak_positive(label))


def positives_only(df: DataFrame, label: str = "is_click") -> DataFrame:
    """R3."""
    return df.where(F.col(label) == 1)


def cap_per_user(df: DataFrame, cap: int, row_id: str = "event_id", user: str = "user_id", seed: int = 42) -> DataFrame:
    """At most ``cap`` random rows per user, the same rows on every run."""
    return top_k(df, [user], [hash_fraction(row_id, seed=seed), row_id], cap, None)


def capped_rows(df: DataFrame, cap: int, user: str = "user_id") -> DataFrame:
    """Rows a cap would drop and batches it would leave behind."""
    sizes = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum(F.greatest(F.col("n") - cap, F.lit(0))).alias("dropped"),
        F.sum(F.least(F.col("n"), F.lit(cap))).alias("kept"),
    )


def rebalance(df: DataFrame, label: str = "is_click", row_id: str = "event_id", seed: int = 42) -> DataFrame:
    """Class-balanced resampling with replacement to exactly the table's size.

    A row's weight is the number of negatives for a positive and of positives
    for a negative, so both classes have the same total, and the draw is
    systematic: with the classes' rows in hashed order, each row takes the whole
    numbers that the running total of expected copies passes on it.  Each class
    gives half of the rows (positives the odd one), and no two rows of a class
    differ by more than one copy.  A table of one class is taken as it is; rows
    without a 0/1 label take no part.
    """
    rows = df.where(F.col(label).isin(0, 1)).withColumn("_at", hash_fraction(row_id, seed=seed))
    rows = rows.withColumn("_class", F.col(label).cast("int"))
    counts = rows.agg(F.count_if(F.col("_class") == 1).alias("p"), F.count_if(F.col("_class") == 0).alias("n")).first()
    pos, neg = counts["p"], counts["n"]
    taken = ((pos + neg + 1) // 2, (pos + neg) // 2) if pos and neg else (pos, neg)
    placed = dense_index(rows, ["_class", "_at", row_id], "_place")  # negatives first
    positive = F.col("_class") == 1
    whole = lambda v: F.lit(v).cast("decimal(38,0)")  # noqa: E731  products of two counts
    place = F.when(positive, F.col("_place") - neg).otherwise(F.col("_place")).cast("decimal(19,0)")
    total, size = F.when(positive, whole(taken[0])).otherwise(whole(taken[1])), F.when(positive, whole(pos)).otherwise(whole(neg))
    passed = lambda p: F.call_function("div", (p * total.cast("decimal(19,0)")), size)
    copies = (passed(place + 1) - passed(place)).cast("int")
    return (
        placed.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .select(*df.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    )


def dot(a: str, b: str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def hard_negatives(
    pairs: DataFrame,
    user_vectors: DataFrame,
    item_vectors: DataFrame,
    margin: float = 0.2,
    label: str = "is_click",
    asked: int = 8,
) -> DataFrame:
    """Each positive with the hardest negative of the shared pool, and the triplet loss.

    The pool are the items that any user left unclicked.  The anchor is the
    user, so the hardest negative is one item per user: the most similar one of
    the pool that is no positive of this user.  Users ask for their ``asked``
    nearest items of the pool; those who find only positives of their own among
    them ask again for four times as many, until each has one.  A positive whose
    user has clicked the whole pool stays, without a negative and a loss.
    Vectors are unit length; pairs without one of the vectors take no part.
    """
    keys = ["live_id", "streamer_id"]
    # One label for each pair: a pair that was both shown and clicked is a positive, never its own negative.
    labelled = materialise(pairs.groupBy("user_id", *keys).agg(F.max(label).alias("_label")))
    pool = dense_index(labelled.where("_label <> 1").join(item_vectors.select(*keys), keys).select(*keys).distinct(), keys, "item_id")
    pool = materialise(pool)
    vectors = materialise(pool.join(item_vectors, keys).select("item_id", "vector"))
    clicked = labelled.where("_label = 1").drop("_label")
    positives = (
        clicked.join(user_vectors.withColumnRenamed("vector", "_u"), "user_id")
        .join(item_vectors.withColumnRenamed("vector", "_v"), keys)
        .select("user_id", *keys, dot("_u", "_v").alias("pos_sim"))
    )
    positives = materialise(positives)
    own = materialise(clicked.join(pool, keys).select(F.col("user_id").alias("query_id"), "item_id"))
    waiting = positives.select("user_id").distinct().join(user_vectors, "user_id")
    waiting = materialise(waiting.select(F.col("user_id").alias("query_id"), "vector"))
    size, hardest = pool.count(), None
    while True:
        # Ties fall to the smaller item, as in the lists themselves.
        free = nearest_items(waiting, vectors, asked).join(own, ["query_id", "item_id"], "left_anti")
        first = F.min_by(F.struct("item_id", F.col("score").alias("neg_sim")), "rank").alias("_n")
        found = materialise(free.groupBy("query_id").agg(first).select("query_id", "_n.*"))
        hardest = found if hardest is None else hardest.unionByName(found)
        waiting = materialise(waiting.join(found, "query_id", "left_anti"))
        if asked >= size or waiting.isEmpty():
            break
        asked *= 4
    named = hardest.join(pool, "item_id").select(
        F.col("query_id").alias("user_id"), F.col("live_id").alias("neg_live_id"),
        F.col("streamer_id").alias("neg_streamer_id"), "neg_sim",
    )
    loss = F.greatest(F.lit(margin) + (F.lit(1.0) - F.col("pos_sim")) - (F.lit(1.0) - F.col("neg_sim")), F.lit(0.0))
    return positives.join(named, "user_id", "left").withColumn("loss", F.when(F.col("neg_sim").isNotNull(), loss))


def require_split(df: DataFrame, allowed: Sequence[str] = ("test",), column: str = "split") -> DataFrame:
    """Refuse rows of another split before an evaluation runs on them."""
    wrong = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).limit(1).collect()
    if wrong:
        raise ValueError(f"evaluation needs split in {list(allowed)}, found {wrong[0][0]!r}")
    return df


def guarded_split(df: DataFrame, allowed: Sequence[str] = ("test",), column: str = "split") -> DataFrame:
    """Lazy form of the guard: the job fails when it meets a row of another split.

    The check is a filter, so it runs whatever columns a consumer reads.
    """
    ok = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    refuse = F.raise_error(F.lit(f"evaluation needs split in {list(allowed)}")).cast("boolean")
    return df.where(F.when(ok, F.lit(True)).otherwise(refuse))


def fit_ranker(
    train: DataFrame, features: Sequence[str], binary: Mapping[str, str], regression: tuple[str, str], rounds: int = 20
) -> PipelineModel:
    """Distributed multitask ranker: one logistic head per binary task, a Huber head for watch time.

    ``binary`` maps a label to its score column, ``regression`` is (label, score column).
    """
    stages = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")]
    for label, score in binary.items():
        stages.append(
            LogisticRegression(
                featuresCol="_features", labelCol=label, probabilityCol=f"_p_{score}", rawPredictionCol=f"_r_{score}",
                predictionCol=f"_c_{score}", maxIter=rounds, regParam=1e-4,
            )
        )
    stages.append(
        LinearRegression(
            featuresCol="_features", labelCol=regression[0], predictionCol=regression[1], loss="huber",
            maxIter=rounds, regParam=1e-4,
        )
    )
    model = Pipeline(stages=stages).fit(train)
    # A fitted head holds its training summary, and with it the session, which some sessions cannot send to tasks: the
    # stored model is the head alone.
    path = f"{shared_folder(train.sparkSession)}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel.load(path)


def score_rows(model, df: DataFrame, binary: Mapping[str, str], regression: tuple[str, str]) -> DataFrame:
    """Task scores per row and their mean."""
    out = model.transform(df)
    scores = [vector_to_array(F.col(f"_p_{s}")).getItem(1).alias(s) for s in binary.values()]
    out = out.select(*df.columns, *scores, regression[1])
    total = sum((F.col(s) for s in binary.values()), F.lit(0.0))
    return out.withColumn("score_multitask_mean", total / F.lit(float(len(binary))))


def ranker_gradients(
    model, train: DataFrame, features: Sequence[str], binary: Mapping[str, str], regression: tuple[str, str]
) -> DataFrame:
    """(head, rows, gradient): how far each head is from its optimum.

    The largest partial derivative of the head's regularised mean loss, by
    intercept and standardised coefficients, from one aggregate over the rows:
    the fit's own condition, whatever way it took.
    """
    heads = [*binary.items(), regression]
    fitted = dict(zip([h for h, _ in heads], model.stages[1:]))
    scored = score_rows(model, train, binary, regression)
    pulls = {}
    for label, score in heads:
        head, y = fitted[label], F.col(label).cast("double")
        if label in binary:
            pulls[label] = F.col(score) - y
        else:  # the Huber loss is linear beyond epsilon deviations
            bound, off = head.getEpsilon(), (y - F.col(score)) / F.lit(head.scale)
            pulls[label] = -F.least(F.greatest(off, F.lit(-bound)), F.lit(bound))
    row = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.stddev_samp(x).alias(f"s{j}") for j, x in enumerate(features)],
        *[F.avg(p).alias(f"g_{h}") for h, p in pulls.items()],
        *[F.avg(p * F.col(x)).alias(f"g_{h}_{j}") for h, p in pulls.items() for j, x in enumerate(features)],
    ).first()
    out = []
    for label, _ in heads:
        head, parts = fitted[label], [abs(row[f"g_{label}"] or 0.0)]
        for j, weight in enumerate(head.coefficients.toArray().tolist()):
            if row[f"s{j}"]:
                parts.append(abs(row[f"g_{label}_{j}"] / row[f"s{j}"] + head.getRegParam() * weight * row[f"s{j}"]))
        out.append((label, row["rows"], float(max(parts))))
    return train.sparkSession.createDataFrame(out, "head string, rows bigint, gradient double")


def factor_vectors(
    pairs: DataFrame, rank: int = 16, rounds: int = 5, user: str = "user_id", item: str = "item_id", weight: str = "weight"
) -> tuple[DataFrame, DataFrame]:
    """User and item vectors from implicit feedback.

    A task of the fit holds one block of users or items with its ratings, so their number follows ``pairs``, a stored table.
    """
    blocks = max(LEAST_BLOCKS, -(-pairs.count() // BLOCK_RATINGS))
    model = ALS(
        rank=rank, maxIter=rounds, userCol=user, itemCol=item, ratingCol=weight, implicitPrefs=True, seed=42,
        numUserBlocks=blocks, numItemBlocks=blocks,
    ).fit(pairs)
    users = model.userFactors.select(F.col("id").cast("bigint").alias(user), F.col("features").alias("vector"))
    items = model.itemFactors.select(F.col("id").cast("bigint").alias(item), F.col("features").alias("vector"))
    return users, items


def factor_residuals(
    pairs: DataFrame,
    users: DataFrame,
    items: DataFrame,
    reg: float = 0.1,
    alpha: float = 1.0,
    user: str = "user_id",
    item: str = "item_id",
    weight: str = "weight",
) -> DataFrame:
    """(user, residual): how far each user's vector is from its normal equations, as a share of their right side.

    The last step of the fit solves the users' equations with the items' vectors held; ``reg`` and ``alpha`` are its
    settings.  The items' Gram matrix is one row, and a user's sums are one aggregate over their pairs.
    """
    width = range(users.select(F.size("vector")).first()[0])
    at = lambda c, i: F.col(c)[i].cast("double")
    gram = items.agg(*[F.sum(at("vector", i) * at("vector", j)).alias(f"m{i}_{j}") for i in width for j in width]).first()
    met = pairs.join(items.withColumnRenamed("vector", "_y"), item).join(users.withColumnRenamed("vector", "_x"), user)
    sure = alpha * F.abs(F.col(weight).cast("double"))
    liked = F.col(weight) > 0
    met = met.withColumns({"_sure": sure, "_dot": dot("_x", "_y"), "_liked": liked})
    right = F.when(F.col("_liked"), 1.0 + F.col("_sure")).otherwise(0.0)
    sums = met.groupBy(user).agg(
        F.first("_x").alias("_x"),
        F.count_if("_liked").alias("_n"),
        *[F.sum(F.col("_sure") * F.col("_dot") * at("_y", i)).alias(f"l{i}") for i in width],
        *[F.sum(right * at("_y", i)).alias(f"r{i}") for i in width],
    )
    gaps = []
    for i in width:
        product = sum((F.lit(float(gram[f"m{i}_{j}"])) * at("_x", j) for j in width), F.lit(0.0))
        gaps.append(F.abs(product + F.col(f"l{i}") + reg * F.col("_n") * at("_x", i) - F.col(f"r{i}")))
    scale = F.greatest(*[F.abs(f"r{i}") for i in width])
    return sums.select(user, (F.greatest(*gaps) / F.when(scale > 0, scale).otherwise(1.0)).alias("residual"))
