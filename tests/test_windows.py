import pytest
from tests.helpers import DAY, MIN, by_id, earlier, frame, log_rows, past, watch_median
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR_US
from tidemark.operators.medians import past_medians
from tidemark.operators.rolling import Past, past_aggregates, rolling_distinct, skips_since
from tidemark.operators.skew import RANGE_ROWS, RANGES, SLICES, GroupSizes, group_sizes, grown, range_count, slice_cuts
from tidemark.plans.features import KEYS, build_features, family_columns, measure_keys

COLD = {k: GroupSizes(1) for k in KEYS}


def one(user, t, event, click=1, live=1, watch=10.0):
    return dict(
        event_id=event, user_id=user, live_id=live, streamer_id=live % 2, t_us=t, is_click=click,
        watch_live_time=watch if click else 0.0, is_like=0, is_comment=0, is_gift=0, gift_price=0.0,
        live_content_category_le=0,
    )


def test_frame_edges(spark):
    w = 15 * MIN
    rows = [one(1, 0, 0), one(1, w, 1), one(1, w, 2, click=0), one(1, 2 * w + 1, 3), one(2, 5 * w, 4, click=0)]
    got = by_id(build_features(frame(spark, rows), ["W1", "W2", "W3"], COLD))
    assert got[0]["ctr_user_15min"] == 0 and got[0]["num_imp_user_10min"] == 0
    # The row exactly at t - w counts, the row of the same instant does not.
    assert got[1]["num_click_user_15min"] == 1 and got[2]["num_click_user_15min"] == 1
    assert got[3]["num_click_user_15min"] == 0 and got[3]["click_trend_user"] == 0
    assert got[4]["num_imp_user_7d"] == 0


def test_first_row_of_a_key_sees_nothing(spark):
    rows = [one(1, 10, 0), one(1, 20, 1), one(2, 30, 2), one(2, 40, 3, click=0), one(2, 50, 4, click=0)]
    got = by_id(build_features(frame(spark, rows), ["W4", "W5", "W6", "W7", "W8", "W23"], COLD))
    assert got[2]["tsli_missing"] == 1 and got[2]["tslc_missing"] == 1
    assert got[2]["avg_watch_time_user_missing"] == 1 and got[2]["comment_rate_user"] == 0
    assert got[2]["tslc_user_streamer_missing"] == 1
    assert [got[i]["consecutive_skips_user"] for i in range(5)] == [0, 0, 0, 1, 2]
    assert got[4]["time_since_last_click_user"] == pytest.approx(0.02)


def test_against_plain_python(spark):
    rows = log_rows(250)
    got = by_id(build_features(frame(spark, rows), ["W1", "W7", "W14", "W17", "W19"], COLD))
    for r in rows:
        g = got[r["event_id"]]
        week = past(rows, r, "user_id", 7 * DAY)
        assert g["ctr_user_7d"] == pytest.approx(sum(x["is_click"] for x in week) / len(week) if week else 0)
        assert g["median_watch_time_user"] == pytest.approx(watch_median(earlier(rows, r, "user_id")))
        assert g["median_watch_time_live_30min"] == pytest.approx(watch_median(past(rows, r, "live_id", 30 * MIN)))
        assert g["amount_gift_live_1hr"] == pytest.approx(sum(x["gift_price"] for x in past(rows, r, "live_id", 60 * MIN)))
        assert g["num_lives_streamer_7d"] == len({x["live_id"] for x in past(rows, r, "streamer_id", 7 * DAY)})


@pytest.mark.parametrize("ids", [("W3", "W5", "W10", "W24"), ("W14", "W17"), ("W19", "W20", "W21"), ("W6", "W22", "W23")])
def test_split_plans_equal_plain_plans(spark, ids):
    df = frame(spark, log_rows(500))
    sizes = measure_keys(df, hot_rows=60)
    assert all(sizes[k].hot is not None for k in ("user", "room", "streamer"))
    plain = by_id(build_features(df, ids, COLD, strategy="range"))
    split = by_id(build_features(df, ids, sizes, strategy="expiry"))
    assert plain.keys() == split.keys()
    for i, row in plain.items():
        for name in family_columns(ids):
            assert split[i][name] == pytest.approx(row[name], abs=1e-9), (i, name)


def test_no_leakage(spark):
    rows = log_rows(200)
    ids = ("W1", "W5", "W6", "W7", "W12", "W14", "W19", "W23")
    whole = by_id(build_features(frame(spark, rows), ids, COLD))
    limit = rows[120]["t_us"]
    kept = [r for r in rows if r["t_us"] <= limit]
    part = by_id(build_features(frame(spark, kept), ids, COLD))
    for i, row in part.items():
        assert row == whole[i]


def test_unknown_category_is_zero(spark):
    rows = log_rows(120)
    got = by_id(build_features(frame(spark, rows), ["W24"], COLD))
    blank = [r["event_id"] for r in rows if r["live_content_category_le"] is None]
    assert blank and all(got[i]["num_imp_user_category_7d"] == 0 for i in blank)


@pytest.mark.parametrize("bins", [1, 5, 64])
def test_hot_medians_are_exact(spark, bins):
    rows = log_rows(700, hot_share=0.8, seed=bins)
    for i, r in enumerate(rows):
        # The hot live has no id: a null key is a group like any other.
        r["live_id"] = None if bins == 5 and r["live_id"] == 0 else r["live_id"]
        # Hardly any value twice.
        r["watch_live_time"] += i / 1000
    df = frame(spark, rows).withColumn("w", F.when(F.col("is_click") == 1, F.col("watch_live_time")))
    hot = group_sizes(df, ["live_id"], hot_rows=40)[0]
    widths = {"all": None, "half": 30 * MIN, "short": MIN, "long": 40 * DAY}
    got = by_id(past_medians(df, ["live_id"], "w", widths, hot, bins=bins))
    assert got.keys() == {r["event_id"] for r in rows}
    for r in rows:
        g = got[r["event_id"]]
        assert (g["all"] or 0.0) == pytest.approx(watch_median(earlier(rows, r, "live_id")))
        for name, width in (("half", 30 * MIN), ("short", MIN), ("long", 40 * DAY)):
            assert (g[name] or 0.0) == pytest.approx(watch_median(past(rows, r, "live_id", width))), (name, r)


def test_hot_medians_without_times(spark):
    """Rows without a time come first, see nothing in a window and are in none."""
    rows = [(i, 1, None if i % 5 == 0 else i * MIN, float(i * 37 % 101)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, live_id bigint, t_us bigint, w double")
    hot = group_sizes(df, ["live_id"], hot_rows=20)[0]
    widths = {"all": None, "some": 20 * MIN}
    plain = by_id(past_medians(df, ["live_id"], "w", widths, GroupSizes(1)))
    assert by_id(past_medians(df, ["live_id"], "w", widths, hot)) == plain and plain[0]["some"] is None and plain[7]["some"] is not None


@pytest.mark.parametrize("slices", [4, 20, 100])
def test_rows_moved_for_hot_medians(spark, slices):
    """Whatever the number of slices and however many of them a window spans, few rows move besides the own ones."""
    from tidemark.operators.medians import solver_rows

    n = 20_000
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(1).alias("live_id"), (F.col("id") * MIN).alias("t_us"),
        (F.xxhash64("id") % 100_003).cast("double").alias("w"),
    )
    hot = group_sizes(df, ["live_id"], hot_rows=2 * n // slices)[0]
    for widths, most in (([None], 1.7), ([n // 3 * MIN], 3), ([n // 20 * MIN], 3.1)):
        moved = solver_rows(df, ["live_id"], "w", widths, hot)
        assert moved.where("_stretch is null").isEmpty() and moved.count() <= most * n, widths


def test_expiry_and_distinct_on_hot_keys(spark):
    rows = log_rows(300)
    df = frame(spark, rows).withColumn("one", F.lit(1))
    hot = group_sizes(df, ["streamer_id"], hot_rows=20)[0]
    specs = [Past("n", "one", 6 * HOUR_US), Past("g", "gift_price", 6 * HOUR_US, amount=True), Past("c", "is_click")]
    got = by_id(past_aggregates(df, ["streamer_id"], specs, hot, "expiry"))
    users = by_id(rolling_distinct(df, ["streamer_id"], "user_id", 2 * HOUR_US, "u", hot))
    for r in rows:
        inside = past(rows, r, "streamer_id", 6 * HOUR_US)
        assert got[r["event_id"]]["n"] == len(inside)
        assert got[r["event_id"]]["g"] == pytest.approx(sum(x["gift_price"] for x in inside))
        assert got[r["event_id"]]["c"] == sum(x["is_click"] for x in earlier(rows, r, "streamer_id"))
        assert users[r["event_id"]]["u"] == len({x["user_id"] for x in past(rows, r, "streamer_id", 2 * HOUR_US)})


def test_skips_on_hot_keys(spark):
    rows = log_rows(200)
    df = frame(spark, rows)
    hot = group_sizes(df, ["user_id"], hot_rows=20)[0]
    a = by_id(skips_since(df, ["user_id"], "is_click", "s", GroupSizes(1)))
    b = by_id(skips_since(df, ["user_id"], "is_click", "s", hot))
    assert {k: v["s"] for k, v in a.items()} == {k: v["s"] for k, v in b.items()}


def test_group_sizes_find_every_hot_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.col("id")).alias("k"))
    size = group_sizes(df, ["k"], hot_rows=2_000)[0]
    assert size.largest >= 2_857
    assert sorted(r["k"] for r in size.hot.collect()) == list(range(7))
    assert group_sizes(df, ["k"], hot_rows=5_000)[0].hot is None


def test_plans_agree_on_fractions_and_missing_times(spark):
    rows = [(i, 1, None if i % 4 == 0 else i * MIN, 0.5) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, t_us bigint, x double")
    specs = [Past("s", "x", 5 * MIN), Past("all", "x")]
    hot = group_sizes(df, ["user_id"], hot_rows=3)[0]
    plain = by_id(past_aggregates(df, ["user_id"], specs, GroupSizes(1), "range"))
    split = by_id(past_aggregates(df, ["user_id"], specs, hot, "expiry"))
    assert hot.hot is not None and plain == split
    assert plain[0]["s"] == 0 and plain[3]["s"] == 1.0 and plain[11]["s"] == pytest.approx(0.5 * 4)
    with pytest.raises(ValueError):
        Past("m", "x", MIN, "max")


def test_median_time_grows_with_the_rows():
    import time

    import numpy as np

    from tidemark.operators.medians import ranged_smallest

    rng = np.random.default_rng(1)
    small = rng.random(300)
    left, right = np.zeros(299, np.int64), np.arange(1, 300)
    expected = [np.sort(small[:r])[r // 2] for r in right]
    assert ranged_smallest(small, left, right, right // 2).tolist() == expected
    took = []
    for n in (50_000, 400_000):
        values, ends, start = rng.random(n), np.arange(1, n), time.process_time()
        ranged_smallest(values, np.zeros(n - 1, np.int64), ends, ends // 2)
        took.append((time.process_time() - start) / n)
    assert took[1] < 5 * took[0]


def test_wide_row_is_put_together_without_an_exchange(spark):
    """The features of each key are stored by row number and meet where they lie; repeated rows stay apart."""
    rows = log_rows(200)
    df = frame(spark, [*rows, rows[0]])
    ids = ["W1", "W5", "W14", "W18", "W24"]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = build_features(df, ids, measure_keys(df, hot_rows=60), strategy="expiry")
        got = wide.collect()
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("SortMergeJoin") >= 3 and "Exchange" not in plan
    assert len(got) == 201 and set(wide.columns) == {*df.columns, *family_columns(ids)}


def test_slices_and_ranges_grow_with_the_table(spark):
    """However small the wanted slices, cuts and ranges stay few; beyond what a task holds their number follows the rows."""
    df = spark.range(5000).selectExpr("1L AS user_id", "id AS t_us")
    sizes = group_sizes(df, ["user_id"], hot_rows=4)[0]
    assert len(slice_cuts(df, ["user_id"], "t_us", sizes).first()["_cuts"]) == SLICES - 1
    assert grown(GroupSizes()) == GroupSizes()
    assert range_count(6_000_000, 37) == RANGES and range_count(100, 37) == 3 and range_count(0) == 1
    assert range_count(1_000 * RANGE_ROWS) == 1_000
