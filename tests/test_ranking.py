"""Candidates, retrieval, reranking and metrics against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bounded, candidates, metrics, ranking, rerank, retrieval, training
from tidemark.operators.bounded import bounded_top_k
from tidemark.operators.skew import group_sizes

ATTR = "country double, age double, brand double, price double"


def brute_rules(users, items, k, cross=False, gap=3, strict=False, price_gap=3):
    out = set()
    for u in users:
        rows = []
        for i in items:
            equal = lambda a, b: a is None or b is None or a == b
            near = lambda a, b, g: g < 0 or a is None or b is None or abs(a - b) <= g
            if (
                i[1] != u[0]
                and (cross or equal(u[1], i[3]))
                and near(u[2], i[4], gap)
                and (not strict or equal(u[3], i[5]))
                and near(u[4], i[6], price_gap)
            ):
                rows.append((-i[2], i[0], i[1]))
        out |= {(u[0], live, s, r + 1) for r, (_, live, s) in enumerate(sorted(rows)[:k])}
    return out


@pytest.mark.parametrize(
    "options", [{}, {"allow_cross_country": True}, {"strict_brand": True, "max_age_gap": -1}, {"max_price_gap": 0}]
)
def test_rule_candidates_are_exact(spark, options):
    rng = random.Random(9)
    pick = lambda n: None if rng.random() < 0.15 else float(rng.randrange(n))
    users = [(u, pick(3), pick(6), pick(2), pick(5)) for u in range(40)]
    # Few streamers, who are users too and own many of the best lives.
    items = [(i, rng.randrange(6), round(rng.random(), 2), pick(3), pick(6), pick(2), pick(5)) for i in range(150)]
    got = candidates.rule_candidates(
        spark.createDataFrame(users, "user_id bigint, " + ATTR),
        spark.createDataFrame(items, "live_id bigint, streamer_id bigint, rule_score double, " + ATTR),
        4,
        **options,
    )
    want = brute_rules(
        users, items, 4, options.get("allow_cross_country", False), options.get("max_age_gap", 3),
        options.get("strict_brand", False), options.get("max_price_gap", 3),
    )
    assert {(r["user_id"], r["live_id"], r["streamer_id"], r["rank"]) for r in got.collect()} == want


def test_self_exclusion_with_many_own_lives(spark):
    users = [(1, 1.0, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0, 1.0)]
    items = [(i, 1, 1.0 - i / 100, 1.0, 1.0, 1.0, 1.0) for i in range(30)]
    items += [(100 + i, 3, 0.1 - i / 100, 1.0, 1.0, 1.0, 1.0) for i in range(5)]
    got = candidates.rule_candidates(
        spark.createDataFrame(users, "user_id bigint, " + ATTR),
        spark.createDataFrame(items, "live_id bigint, streamer_id bigint, rule_score double, " + ATTR),
        3,
    )
    lists = {u: [r["live_id"] for r in sorted(got.collect(), key=lambda r: r["rank"]) if r["user_id"] == u] for u in (1, 2)}
    assert lists == {1: [100, 101, 102], 2: [0, 1, 2]}


def test_inner_product_blocks_and_ties(spark):
    rng = np.random.default_rng(4)
    items = np.round(rng.normal(size=(60, 3)), 1)
    items[10:20] = items[0]  # exact ties
    queries = np.round(rng.normal(size=(25, 3)), 1)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<float>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id bigint, vector array<float>")
    for blocks in ((100, 100), (7, 11)):
        got = {(r["query_id"], r["rank"]): r for r in retrieval.inner_product_top_k(q, t, 5, *blocks).collect()}
        assert len(got) == 125
        for i, v in enumerate(queries):
            scores = items.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float)
            best = sorted(range(60), key=lambda j: (-round(scores[j], 9), j))[:5]
            assert [got[(i, r)]["item_id"] for r in range(1, 6)] == best


def test_mmr_limits_and_ties(spark):
    schema = "user_id bigint, live_id bigint, streamer_id bigint, relevance_score double, kind string"
    rows = [(1, i, i, 1.0 - i / 10, "a" if i < 3 else "b") for i in range(5)] + [(2, i, i, 0.5, None) for i in range(3)]
    listed = rerank.prefilter(spark.createDataFrame(rows, schema), 4)
    order = lambda lam: {
        u: [r["live_id"] for r in sorted(rerank.mmr(listed, lam, 4, ["kind"]).collect(), key=lambda r: r["rank"]) if r["user_id"] == u]
        for u in (1, 2)
    }
    assert order(1.0) == {1: [0, 1, 2, 3], 2: [0, 1, 2]}
    assert order(0.0)[1][:2] == [0, 3]  # the first of another kind
    assert order(0.5)[2] == [0, 1, 2]  # identical items keep their order


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1), 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double, one int")
    got = {r["metric"]: r["value"] for r in metrics.auc(df, {"a": ("y", "s"), "b": ("one", "s")}).collect()}
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["auc_a"] == pytest.approx(want) and got["auc_b"] is None


def test_list_metrics(spark):
    rows = [(1, 1, 1, 1, 0.9), (1, 2, 1, 0, 0.8), (1, 3, 1, 1, 0.7), (2, 1, 1, 0, 0.5), (2, 2, 1, 0, 0.4), (3, 1, 1, 1, 0.1)]
    df = spark.createDataFrame(rows, "user_id bigint, live_id bigint, streamer_id bigint, y int, s double")
    got = {r["metric"]: r["value"] for r in metrics.list_metrics(df, "y", "s", [2, 10]).collect()}
    assert got["precision@2"] == pytest.approx((0.5 + 0 + 1) / 3)  # a short list divides by its length
    assert got["recall@2"] == pytest.approx((0.5 + 1) / 2)  # users without positives are skipped
    ndcg = (1.0 / (1 + 1 / math.log2(3)) + 1) / 2
    assert got["ndcg@2"] == pytest.approx(ndcg) and got["recall@10"] == 1.0
    assert all(0 <= v <= 1 for v in got.values())


def test_recall_grows_with_k(spark):
    df = spark.range(300).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 31).alias("live_id"), (F.col("id") % 5).alias("streamer_id"),
        (F.col("id") % 3 == 0).cast("int").alias("is_click"),
    )
    lists = ranking.top_k(df.distinct(), ["user_id"], ["live_id", "streamer_id", "is_click"], 40)
    got = {r["k"]: r["recall"] for r in retrieval.pool_recall(df, lists, [1, 5, 20, 40]).collect()}
    assert list(got.values()) == sorted(got.values())
    random_ = {r["k"]: r["recall"] for r in retrieval.random_recall(df, [5, 10_000]).collect()}
    assert random_[10_000] == 1.0 and 0 <= random_[5] < 0.5


def test_hard_negative_is_the_most_similar(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id bigint, vector array<double>")
    items = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.6]), (3, 0, [0.0, 1.0])],
        "live_id bigint, streamer_id bigint, vector array<double>",
    )
    pairs = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 0), (1, 3, 0, 0)], "user_id bigint, live_id bigint, streamer_id bigint, is_click int")
    row = training.hard_negatives(pairs, users, items).first()
    assert row["neg_live_id"] == 2 and row["loss"] == pytest.approx(max(0.2 + 0 - 0.2, 0), abs=1e-9)


def test_hard_negatives_of_a_shared_pool(spark):
    """Users without a negative of their own, users whose nearest items are all positives, a user who clicked the pool."""
    rng = np.random.default_rng(3)
    unit = lambda n: [v / np.linalg.norm(v) for v in rng.normal(size=(n, 4))]
    items, users = unit(60), unit(30)
    near = {u: sorted(range(60), key=lambda i: (-float(items[i] @ users[u]), i)) for u in range(30)}
    clicks = {u: set(near[u][: [1, 3, 12, 40][u % 4]]) for u in range(29)} | {29: set(range(60))}
    shown = {(u, i) for u in range(0, 30, 2) for i in rng.integers(0, 60, 4).tolist() if i not in clicks[u]}
    pairs = [(u, i, i % 3, 1) for u in clicks for i in clicks[u]] + [(u, i, i % 3, 0) for u, i in shown]
    pool = {i for _, i in shown}
    frames = (
        spark.createDataFrame(pairs, "user_id bigint, live_id bigint, streamer_id bigint, is_click int"),
        spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_id bigint, vector array<double>"),
        spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(items)], "live_id bigint, streamer_id bigint, vector array<double>"),
    )
    got = {(r["user_id"], r["live_id"]): r for r in training.hard_negatives(*frames, asked=2).collect()}
    assert got.keys() == {(u, i) for u in clicks for i in clicks[u]}
    for (u, i), r in got.items():
        free = [j for j in near[u] if j in pool and j not in clicks[u]]
        assert r["neg_live_id"] == (free[0] if free else None), (u, i)
        if free:
            margin = 0.2 - float(items[i] @ users[u]) + float(items[free[0]] @ users[u])
            assert r["loss"] == pytest.approx(max(margin, 0.0), abs=1e-9)
        else:
            assert u == 29 and r["loss"] is None


def test_guard_fires_whatever_is_read(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, "test"), (2, "train")], "event_id bigint, split string")
    assert training.guarded_split(df.where("split = 'test'")).select("event_id").count() == 1
    with pytest.raises(PySparkException):
        training.guarded_split(df).select("event_id").collect()


def test_a_clicked_pair_is_not_its_own_negative(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 0), (1, 2, 1, 0)], "user_id bigint, live_id bigint, streamer_id bigint, is_click int")
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id bigint, vector array<float>")
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "live_id bigint, streamer_id bigint, vector array<float>")
    row = training.hard_negatives(pairs, users, items).collect()
    assert [(r["live_id"], r["neg_live_id"], r["loss"]) for r in row] == [(1, 2, 0.0)]


def test_broken_vectors_answer_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [0.5, 0.5]), (5, []), (6, [inf, 0.0]), (7, [0.0, 1.0])]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<float>")
    queries = items.withColumnRenamed("item_id", "query_id")
    got = retrieval.inner_product_top_k(queries, items, 2).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["item_id"])
    assert found == {1: [1, 4], 4: [1, 4], 7: [7, 4]}


def test_long_lists_are_cut_before_pairs_are_compared(spark):
    rows = [(1, i, 0, float(-i), i + 1, i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id bigint, live_id bigint, streamer_id bigint, relevance_score double, rank int, kind int")
    assert rerank.similarity_profile(df, ["kind"]).count() == rerank.PREFILTER
    assert rerank.mmr(df, 1.0, 150, ["kind"]).count() == rerank.PREFILTER


def test_open_rules_join_on_real_keys(spark):
    users = spark.createDataFrame([(u, u % 3, float(u % 7), 0, float(u % 5)) for u in range(50)], "user_id bigint, country int, age double, brand int, price double")
    items = spark.createDataFrame([(i, 1000 + i % 9, float(i % 11), i % 3, float(i % 8) if i % 6 else None, 0, float(i % 9)) for i in range(200)], "live_id bigint, streamer_id bigint, rule_score double, country int, age double, brand int, price double")
    got = candidates.rule_candidates(users, items, 5, allow_cross_country=True, max_age_gap=2, max_price_gap=1)
    expected = set()
    for u in users.collect():
        fitting = [i for i in items.collect() if (i.age is None or abs(i.age - u.age) <= 2) and abs(i.price - u.price) <= 1]
        fitting.sort(key=lambda i: (-i.rule_score, i.live_id, i.streamer_id))
        expected |= {(u.user_id, i.live_id) for i in fitting[:5]}
    assert {(r.user_id, r.live_id) for r in got.collect()} == expected


@pytest.mark.parametrize("pool, k", [(5, 10), (300, 20)])
def test_random_lists_hold_distinct_items(spark, pool, k):
    df = spark.createDataFrame([(u, i, i % 3) for i in range(pool) for u in (i % 4,)], "user_id bigint, live_id bigint, streamer_id bigint")
    lists = {}
    for r in retrieval.random_lists(df, df, k).collect():
        lists.setdefault(r["user_id"], {})[r["rank"]] = r["live_id"]
    assert set(lists) == {0, 1, 2, 3}
    for places in lists.values():
        assert sorted(places) == list(range(1, min(k, pool) + 1)) and len(set(places.values())) == len(places)
    assert len({tuple(sorted(p.items())) for p in lists.values()}) == 4


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_bounded_top_k_equals_brute_force(spark, spread):
    """Clustered and isotropic vectors, exact ties, a crowded cell, fewer items than K asked of, block and chunk borders."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(6, 5)) * 2
    items = middles[rng.integers(0, 6, 400)] + rng.normal(size=(400, 5)) * spread
    items[100:200] = items[0]
    queries = middles[rng.integers(0, 6, 70)] + rng.normal(size=(70, 5)) * spread
    queries[3] = 0
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id bigint, vector array<double>")
    scores = np.round(queries @ items.T, 9)
    for k in (7, 401):
        result = bounded_top_k(q, t, k, 20, 16)
        got = {(r["query_id"], r["rank"]): r["item_id"] for r in result.found.collect()}
        assert len(got) == 70 * min(k, 400)
        for i in range(70):
            best = np.lexsort((np.arange(400), -scores[i]))[:k]
            assert [round(scores[i][got[i, r + 1]], 8) for r in range(len(best))] == [round(scores[i][j], 8) for j in best]
        visits = result.visits.first()
        assert visits["visited"] <= visits["queries"] * visits["blocks"]
        if spread < 1 and k == 7:
            assert visits["visited"] < 0.6 * visits["queries"] * visits["blocks"]


def test_bounded_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, vector array<double>")
    asks = spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>")
    assert bounded_top_k(asks, none, 3).found.count() == 0
    assert bounded_top_k(asks, none, 3).visits.first()["visited"] == 0
    some = spark.createDataFrame([(5, [2.0]), (6, [1.0])], "item_id bigint, vector array<double>")
    assert [r["item_id"] for r in bounded_top_k(asks, some, 3, 1).found.orderBy("rank").collect()] == [5, 6]
    assert bounded_top_k(asks.limit(0), some, 3, 1).found.count() == 0


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_rank_in_group_over_ranges(spark, range_rows):
    """A hot key over many ranges, a null key, descending order, many equal values."""
    rng = random.Random(range_rows)
    rows = [(i, rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([0.0, 0.0, 0.5, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, x double")
    order = [F.col("x").desc(), F.col("event_id")]
    hot = group_sizes(df, ["user_id"], hot_rows=30)[0]
    got = {r["event_id"]: r["rank"] for r in ranking.rank_in_group(df, ["user_id"], order, sizes=hot, range_rows=range_rows).collect()}
    want = {r["event_id"]: r["rank"] for r in ranking.rank_in_group(df, ["user_id"], order).collect()}
    by_key = {}
    for i, k, x in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
        by_key[k] = by_key.get(k, 0) + 1
        assert got[i] == want[i] == by_key[k]


def test_fitted_heads_hold_no_session(spark):
    """Scoring sends the heads to the tasks: a training summary would bring the session along."""
    rows = [(float(i % 7), float(i % 3), i % 2, float(i % 5)) for i in range(60)]
    train = spark.createDataFrame(rows, "x double, z double, y int, w double")
    model = training.fit_ranker(train, ["x", "z"], {"y": "score_y"}, ("w", "score_w"), rounds=3)
    assert not any(stage.hasSummary for stage in model.stages[1:])
    assert training.score_rows(model, train, {"y": "score_y"}, ("w", "score_w")).count() == 60


def test_blocks_and_parts_stay_few(spark):
    """Small blocks and chunks that were asked for grow with the table; the answers stay those of brute force."""
    rng = np.random.default_rng(3)
    items, queries = rng.integers(-50, 50, (3000, 3)).astype(float), rng.integers(-50, 50, (400, 3)).astype(float)
    items[1000:1040] = items[0]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id bigint, vector array<double>")
    assert bounded.chunk_size(900_000, 100, 3, 10) > 50_000 and bounded.chunk_size(50, 100, 3, 10) == 100
    want = {}
    for i, v in enumerate(queries):
        scores = items @ v
        want[i] = [(j, scores[j]) for j in sorted(range(3000), key=lambda j: (-scores[j], j))[:5]]
    for found in (bounded.bounded_top_k(q, t, 5, 20, 30), bounded.bounded_top_k(q, t, 5)):
        got = {}
        for r in sorted(found.found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
        assert got == want
        seen = found.visits.first()
        assert seen["queries"] == 400 and 0 < seen["visited"] <= 400 * seen["blocks"]
    got = {}
    for r in sorted(retrieval.inner_product_top_k(q, t, 5, 10, 10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    assert got == want


def test_boxes_tell_blocks_apart(spark):
    """Items that fill a box, queries that mostly ask for one of its sides: few blocks are visited, the answers stay exact."""
    rng = np.random.default_rng(11)
    items = np.column_stack([rng.integers(900, 1000, 4000), rng.integers(1, 51, 4000) * 40, rng.integers(0, 10, 4000) * 200]).astype(float)
    queries = np.column_stack([rng.integers(-480, -420, 150), rng.integers(-200, 200, 150), rng.integers(-150, 150, 150)]).astype(float)
    items[2000:2030], queries[0], queries[1] = items[0], 0, items[0]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id bigint, vector array<double>")
    result = bounded_top_k(q, t, 5, 20, 50)
    got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in result.found.collect()}
    for i, v in enumerate(queries):
        scores = items @ v
        best = np.lexsort((np.arange(4000), -scores))[:5]
        assert [got[i, r + 1] for r in range(5)] == [(j, scores[j]) for j in best]
    visits = result.visits.first()
    assert visits["items"] == 4000 and 0 < visits["visited"] < 0.05 * visits["queries"] * visits["blocks"]


def test_copies_of_a_vector_do_not_wait(spark):
    """Of items with one score no more than K of each product wait to be ranked, those with the smallest ids."""
    best, vectors = bounded._Best(3, 4, np.full(3, -np.inf)), np.array([[1.0, 0.0], [0.0, 1.0], [np.nan, 1.0]])
    best.look(vectors, np.arange(3), np.tile([2.0, 3.0], (2000, 1)), np.arange(2000))
    assert best.waiting <= 3 * 4 and best.floor[:2].tolist() == [2.0, 3.0]
    row, ids, scores = best.fold()
    assert row.tolist() == [0] * 4 + [1] * 4 and ids.tolist() == [0, 1, 2, 3] * 2 and scores.tolist() == [2.0] * 4 + [3.0] * 4


def test_missing_ids_and_numbers_of_vectors(spark):
    """Rows without an id ask and answer like others; a vector with a gap scores nothing."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (None, [0.0, 1.0])], "query_id bigint, vector array<double>")
    t = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(40)] + [(None, [50.0, 0.0]), (99, [None, 1.0])], "item_id bigint, vector array<double>")
    for found in (bounded.bounded_top_k(q, t, 2, 10, 1).found, retrieval.inner_product_top_k(q, t, 2)):
        got = {(r["query_id"], r["rank"]): (r["item_id"], r["score"]) for r in found.collect()}
        assert got[(1, 1)] == (None, 50.0) and got[(1, 2)] == (39, 39.0) and len(got) == 4


def test_factor_blocks_follow_the_ratings(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK_RATINGS", 20)
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(30) for i in range(20)]
    pairs = spark.createDataFrame(rows, "user_id int, item_id int, weight float")
    users, items = training.factor_vectors(pairs, rank=2, rounds=3)
    assert users.rdd.getNumPartitions() == items.rdd.getNumPartitions() == 30
    gaps = training.factor_residuals(pairs, users, items).collect()
    assert len(gaps) == 30 and max(g["residual"] for g in gaps) < 1e-3


def test_more_rows_make_more_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        groups = spark.range(10_000_000).groupBy(F.xxhash64("id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        # Some 110 MB of shuffled rows: merged by parallelism alone they are one task for each core.
        assert groups.rdd.getNumPartitions() >= 1.5 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
