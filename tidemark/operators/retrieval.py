"""Vector retrieval (T4-T7, J9, M8-M10): exact inner-product top-K, by blocks or by bounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounded import bounded_top_k, cell_answers, chunk_size, tile_rows, tile_scan
from tidemark.operators.dedup import best_row
from tidemark.operators.ranking import top_k
from tidemark.operators.skew import dense_index
from tidemark.session import materialise

#: Bytes of vectors, as doubles, of the items that are scanned without bounds.
ITEM_BYTES = 32 << 20
#: Parts of the items of a scan without bounds before parts grow.
ITEM_PARTS = 4
ITEM_KEYS = ["live_id", "streamer_id"]


def usable_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    """Rows with a vector of finite numbers only; a missing or broken vector answers nothing."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)


def inner_product_top_k(
    queries: DataFrame, items: DataFrame, k: int, user_block: int | None = None, item_block: int | None = None
) -> DataFrame:
    """Exact top-K items per query vector (T4).

    ``queries`` is (query_id, vector), ``items`` (item_id, vector).  Both sides
    are cut into parts by a hash of the id: of the given sizes while parts are
    few, then growing to what a task holds by the vectors' width.  Each pair of
    parts is scanned strip by strip and returns K rows per query, and the K best
    over the parts are kept.  Rows without a finite vector are left out first.
    """
    queries, items = usable_vectors(queries), usable_vectors(items)
    n_queries = queries.count()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n_items, width = size["n"], size["width"] or 1
    user_blocks = max(math.ceil(n_queries / chunk_size(n_queries, user_block, width, k)), 1)
    item_rows = max(item_block or 1, min(math.ceil(n_items / ITEM_PARTS), tile_rows(width)))
    item_blocks = max(math.ceil(n_items / item_rows), 1)
    left = queries.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        F.col("vector").alias("query_vector"),
        F.pmod(F.xxhash64("query_id"), F.lit(user_blocks)).alias("ub"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(item_blocks - 1).cast("bigint"))).alias("ib"),
    )
    right = items.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.col("vector").alias("item_vector"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(user_blocks - 1).cast("bigint"))).alias("ub"),
        F.pmod(F.xxhash64("item_id"), F.lit(item_blocks)).alias("ib"),
    )
    partial = cell_answers(left, right, ["ub", "ib"], user_blocks * item_blocks, tile_scan(k))
    return top_k(partial, ["query_id"], [F.col("score").desc(), "item_id"], k)


def nearest_items(
    queries: DataFrame, items: DataFrame, k: int, user_block: int | None = None, item_block: int | None = None
) -> DataFrame:
    """Exact top-K by whichever way moves less: one block of items is simply scanned, more are skipped by their bounds."""
    queries, items = usable_vectors(queries), usable_vectors(items)
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    if size["n"] <= (item_block or max(ITEM_BYTES // (8 * (size["width"] or 1)), 1)):
        return inner_product_top_k(queries, items, k, user_block, item_block)
    return bounded_top_k(queries, items, k, item_block, user_block).found


def merge_interests(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Union of two candidate lists, best score per item, K best (T5)."""
    columns = ["query_id", "item_id", "score"]
    union = first.select(*columns).unionByName(second.select(*columns))
    best = union.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.col("score").desc(), "item_id"], k)


def item_pool(df: DataFrame) -> DataFrame:
    """Distinct items with their position in key order."""
    return dense_index(df.select(*ITEM_KEYS).distinct(), ITEM_KEYS, "pool_idx")


def pool_positions(df: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows with the pool position of their item, null outside the pool."""
    return df.join(pool, ITEM_KEYS, "left")


def second_interest(source: DataFrame, pool: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Vector of each user's latest pooled item as a second query."""
    known = source.join(pool, ITEM_KEYS).select("user_id", "pool_idx", "t_us", "event_id")
    t = F.col("t_us")
    latest = best_row(known, ["user_id"], [t.isNull(), -t, -F.col("event_id")])
    return latest.join(item_vectors, latest["pool_idx"] == item_vectors["item_id"]).select(
        F.col("user_id").alias("query_id"), "vector"
    )


def retrieve(
    df: DataFrame,
    user_vectors: DataFrame,
    item_vectors: DataFrame,
    k: int,
    interests: int = 1,
    source: DataFrame | None = None,
    **blocks,
) -> DataFrame:
    """Users of ``df`` against its item pool: (user_id, rank, pool_idx, live_id, streamer_id, score).

    ``user_vectors`` is (user_id, vector), ``item_vectors`` (live_id,
    streamer_id, vector); ``source`` holds the interactions whose latest item
    gives the second query.
    """
    pool, vectors, found = _first_interest(df, user_vectors, item_vectors, k, blocks)
    if interests == 2:
        found = _with_second(df if source is None else source, pool, vectors, found, k, blocks)
    return _named(found, pool)


def recommend(rows: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, k: int, interests: int = 1, source: DataFrame | None = None, **blocks) -> DataFrame:
    """T7 for new, unlabelled rows (user_id, live_id, streamer_id): no column of the fit is needed but the vectors.

    Users that the fit has not seen ask with the mean of its users' vectors;
    items that it has not seen keep their place in the pool and are never
    answered.  ``source`` holds the rows whose latest item gives the second
    query, by default the new rows themselves.
    """
    known = usable_vectors(user_vectors)
    width = known.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    mean = F.array(*[F.avg(F.col("vector")[i].cast("double")) for i in range(width)])
    usual = materialise(known.agg(mean.alias("_usual")))  # one row
    asking = rows.select("user_id").distinct().join(known, "user_id", "left").crossJoin(F.broadcast(usual))
    own = F.coalesce(F.col("vector").cast("array<double>"), "_usual").alias("vector")
    return retrieve(rows, materialise(asking.select("user_id", own)), item_vectors, k, interests, source, **blocks)


def retrieve_both(
    df: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, k: int, source: DataFrame | None = None, **blocks
) -> tuple[DataFrame, DataFrame]:
    """The lists of one and of two interests; the first retrieval is done once and shared."""
    pool, vectors, found = _first_interest(df, user_vectors, item_vectors, k, blocks)
    pool, found = materialise(pool), materialise(found)
    both = _with_second(df if source is None else source, pool, vectors, found, k, blocks)
    return _named(found, pool), _named(both, pool)


def _first_interest(df: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, k: int, blocks: dict):
    pool = item_pool(df)
    vectors = item_vectors.join(pool, ITEM_KEYS).select(F.col("pool_idx").alias("item_id"), "vector")
    queries = (
        df.select("user_id").distinct().join(user_vectors, "user_id").select(F.col("user_id").alias("query_id"), "vector")
    )
    return pool, vectors, nearest_items(queries, vectors, k, **blocks)


def _with_second(source: DataFrame, pool: DataFrame, vectors: DataFrame, found: DataFrame, k: int, blocks: dict) -> DataFrame:
    again = nearest_items(second_interest(source, pool, vectors), vectors, k, **blocks)
    return merge_interests(found, again, k)


def _named(found: DataFrame, pool: DataFrame) -> DataFrame:
    named = found.join(pool, found["item_id"] == pool["pool_idx"])
    return named.select(
        F.col("query_id").alias("user_id"), "rank", "pool_idx", "live_id", "streamer_id", "score"
    )


def pool_recall(df: DataFrame, topk: DataFrame, ks: list[int], label: str = "is_click") -> DataFrame:
    """Mean recall@K over users with ground truth in the pool (M8), 0 without such users."""
    truth = df.where(F.col(label) == 1).select("user_id", *ITEM_KEYS).distinct()
    return mean_recall(truth, topk, ["user_id", *ITEM_KEYS], ks)


def mean_recall(truth: DataFrame, ranked: DataFrame, keys: list[str], ks: list[int]) -> DataFrame:
    """(k, recall, users) for several K from one join: a truth pair keeps its best rank."""
    best = ranked.groupBy(*keys).agg(F.min("rank").alias("_rank"))
    per_user = (
        truth.join(best, keys, "left")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_rank") <= k).alias(f"_h{k}") for k in ks])
    )
    row = per_user.agg(
        F.count(F.lit(1)).alias("users"),
        *[F.coalesce(F.avg(F.col(f"_h{k}") / F.col("_n")), F.lit(0.0)).alias(f"_r{k}") for k in ks],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_r{k}").alias("recall")) for k in ks])
    return row.select(F.explode(rows).alias("s"), "users").select("s.k", "s.recall", "users")


def random_lists(users: DataFrame, df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """K random pool items per user without replacement, drawn for each user on its own (M9).

    The pool is put in a hashed order.  A user's draws are hashed places in
    that order, repeats left out; the first K count.  A pool of fewer than 2K
    items is instead ordered anew for each user.  Either way a user holds a
    few times K numbers and no user-item product is formed.
    """
    text = F.concat_ws("|", *ITEM_KEYS, F.lit(str(seed)))
    hashed = df.select(*ITEM_KEYS).distinct().withColumn("_h", F.md5(text))
    placed = materialise(dense_index(hashed, ["_h", *ITEM_KEYS], "_place").drop("_h"))
    size = placed.count()
    number = lambda j: F.conv(
        F.substring(F.md5(F.concat_ws("|", F.col("user_id"), j, F.lit(str(seed)))), 1, 8), 16, 10
    ).cast("bigint")
    if size >= 2 * k:
        tries = F.transform(F.sequence(F.lit(1), F.lit(4 * k + 64)), lambda j: number(j) % size)
        # The places 0..K-1 close the list, for the case that never happens.
        spare = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
        drawn = F.slice(F.array_distinct(F.concat(tries, spare)), 1, k)
    else:
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(max(size - 1, 0)).cast("bigint"))
        order = F.array_sort(F.transform(every, lambda j: F.struct(number(j).alias("at"), j.alias("place"))))
        drawn = F.slice(F.transform(order, lambda s: s["place"]), 1, min(k, max(size, 1)))
    draws = users.select("user_id").distinct().select("user_id", F.posexplode(drawn).alias("_nth", "_at"))
    joined = draws.join(placed, draws["_at"] == placed["_place"])
    return joined.select("user_id", (F.col("_nth") + 1).alias("rank"), *ITEM_KEYS)


def random_recall(df: DataFrame, ks: list[int], label: str = "is_click", seed: int = 42) -> DataFrame:
    """Recall of random lists, the floor for any retriever (M9)."""
    truth = df.where(F.col(label) == 1).select("user_id", *ITEM_KEYS).distinct()
    return mean_recall(truth, random_lists(truth, df, max(ks), seed), ["user_id", *ITEM_KEYS], ks)


def retrieval_report(df: DataFrame, pool: DataFrame, label: str = "is_click") -> DataFrame:
    """Rows, positives, users, pool size and share of positives in the pool."""
    marked = df.join(pool.select(*ITEM_KEYS, F.lit(1).alias("_in")), ITEM_KEYS, "left")
    positive = F.col(label) == 1
    hit = positive & F.col("_in").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(positive).alias("positives"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct(F.when(positive, F.col("user_id"))).alias("users_with_positives"),
        F.count_distinct(*[F.when(F.col("_in") == 1, F.col(c)) for c in ITEM_KEYS]).alias("pool_size"),
        F.count_distinct(F.when(hit, F.col("user_id"))).alias("gt_users"),
        F.count_distinct(*[F.when(hit, F.col(c)) for c in ITEM_KEYS]).alias("pos_pool_intersect"),
        F.coalesce(F.try_divide(F.count_if(hit), F.count_if(positive)), F.lit(0.0)).alias("pos_pool_match_rate"),
    )
