"""Attribution, de-duplication, stream, encoders, scalers, distributed running totals, sources."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, log_rows
from tidemark.functions import columns as c
from tidemark.functions import roles
from tidemark.operators import dedup, encoders, scalers, training
from tidemark.operators.attribution import attribute_followups
from tidemark.operators.skew import GroupSizes, dense_index, global_running, group_sizes
from tidemark.plans.splits import with_split
from tidemark.session import new_table_name, shared_folder
from tidemark.sources import matrices, readers, sinks
from tidemark.sources.schemas import require_columns
from tidemark.streaming.incremental_dedup import current_best, live_runs, start_incremental, upsert_sink

CLICK = "user_id bigint, live_id bigint, streamer_id bigint, t_us bigint, event_id bigint, watch_live_time double"
FOLLOW = "user_id bigint, live_id bigint, streamer_id bigint, t_us bigint, event_id bigint, kind string, amount double"


def test_attribution_edges(spark):
    clicks = spark.createDataFrame([(1, 1, 1, 100, 0, 5.0), (1, 1, 1, 200, 1, 6.0), (2, 1, 1, 150, 2, 7.0)], CLICK)
    follow = spark.createDataFrame(
        [
            (1, 1, 1, 100, 10, "like", None),  # exactly at the click
            (1, 1, 1, 50, 11, "comment", None),  # before any click
            (1, 1, 1, 250, 12, "gift", 3.0),
            (1, 1, 1, 260, 13, "gift", None),  # later, without a price
            (1, 2, 1, 260, 14, "like", None),  # other key
            (None, 1, 1, 260, 15, "like", None),
        ],
        FOLLOW,
    )
    plain = {r["event_id"]: r for r in attribute_followups(clicks, follow, sizes=GroupSizes()).collect()}
    assert plain[0]["is_like"] == 1 and plain[0]["latest_like_us"] == 100 and plain[0]["is_gift"] == 0
    assert plain[1]["latest_gift_us"] == 260 and plain[1]["gift_price"] == 3.0 and plain[1]["is_comment"] == 0
    assert plain[2]["is_like"] == 0 and plain[2]["gift_price"] is None


def test_attribution_of_hot_keys(spark):
    rng = random.Random(5)
    events = [(1, rng.randrange(2), 1, rng.randrange(10**10), i) for i in range(300)]
    clicks = spark.createDataFrame([(*e, 1.0) for e in events[:120]], CLICK)
    follow = spark.createDataFrame([(*e, rng.choice(["like", "gift"]), float(e[4])) for e in events[120:]], FOLLOW)
    keys = ["user_id", "live_id", "streamer_id"]
    events = clicks.select(*keys).unionByName(follow.select(*keys))
    hot = group_sizes(events, keys, hot_rows=20)[0]
    a = sorted(map(str, attribute_followups(clicks, follow, sizes=GroupSizes()).collect()))
    b = sorted(map(str, attribute_followups(clicks, follow, sizes=hot).collect()))
    assert hot.hot is not None and a == b


def test_attribution_of_repeated_clicks(spark):
    """Clicks that agree in key, time and id, some in all columns: one of them has the follow-ups, on every plan and order."""
    rng = random.Random(9)
    rows = [(1, 1, 1, 100 * (i // 3), i // 3, float(rng.randrange(2))) for i in range(240)]
    follow = spark.createDataFrame([(1, 1, 1, 100 * i + 50, 1000 + i, "gift", float(i)) for i in range(80)], FOLLOW)
    keys = ["user_id", "live_id", "streamer_id"]
    results = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        clicks = spark.createDataFrame(rows, CLICK).repartition(5)
        hot = group_sizes(clicks.select(*keys).unionByName(follow.select(*keys)), keys, hot_rows=30)[0]
        results += [sorted(map(str, attribute_followups(clicks, follow, sizes=s).collect())) for s in (GroupSizes(), hot)]
    assert all(r == results[0] for r in results) and len(results[0]) == 240
    assert sum("is_gift=1" in r for r in results[0]) == 80


ROWS = "live_id bigint, streamer_id bigint, user_id bigint, is_click int, t_us bigint, event_id bigint"


def test_click_priority_cases(spark):
    rows = [
        (1, 1, 1, 0, 900, 0), (1, 1, 1, 1, 500, 1), (1, 1, 1, 1, 300, 2),  # earliest click
        (2, 1, 1, 0, 100, 3), (2, 1, 1, 0, 400, 4), (2, 1, 1, 0, None, 5),  # latest view, no time last
        (3, 1, 1, 0, None, 7), (3, 1, 1, 0, None, 6),  # smaller id
        (4, 1, 1, 1, None, 8), (4, 1, 1, 1, 700, 9), (4, 1, 1, 1, 700, 10),
        (5, 1, 1, None, 10, 11),
    ]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted(r["event_id"] for r in dedup.click_priority(df).collect()) == [2, 4, 6, 9, 11]


def test_stream_equals_batch(spark, tmp_path):
    """Files that arrive in two goes: the stream is stopped and started again on its checkpoint."""
    rows = [(r["live_id"], r["streamer_id"], r["user_id"], r["is_click"], r["t_us"], r["event_id"]) for r in log_rows(300)]
    random.Random(1).shuffle(rows)
    target = new_table_name(spark)
    for go, part in enumerate((rows[:120], rows[120:])):
        df = spark.createDataFrame(part, ROWS)
        df.repartition(5).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        start_incremental(stream, target, f"{tmp_path}/state").awaitTermination()
        want = dedup.click_priority(spark.createDataFrame(rows[: 120 if go == 0 else None], ROWS))
        got = current_best(spark, target)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert live_runs(spark, target) == [(0, 7), (8, 9)]


def test_merges_write_what_changed_and_survive_retries(spark):
    """Sixteen batches, each repeated or cut short somewhere: the result holds, and a row is rewritten for each doubling only."""
    rows = [(r["live_id"], r["streamer_id"], r["user_id"], r["is_click"], r["t_us"], r["event_id"]) for r in log_rows(320)]
    target, order = new_table_name(spark), []
    write = upsert_sink(target)
    for n in range(16):
        batch = spark.createDataFrame(rows[20 * n : 20 * n + 20], ROWS)
        write(batch, n)
        if n in (3, 10):
            write(batch, n)  # the driver died after the batch, before its commit
        if n == 5:  # a merge was written, what it replaces not yet dropped
            spark.table(f"{target}_run_4_5").write.saveAsTable(f"{target}_run_4_4")
        order.append(live_runs(spark, target))
        want = dedup.click_priority(spark.createDataFrame(rows[: 20 * n + 20], ROWS))
        if n in (3, 5, 10, 15):
            assert {r["event_id"] for r in current_best(spark, target).collect()} == {r["event_id"] for r in want.collect()}
    assert [len(runs) for runs in order] == [bin(n + 1).count("1") for n in range(16)]
    assert order[6] == [(0, 3), (4, 5), (6, 6)] and order[15] == [(0, 15)]


def test_splits_reconcile(spark):
    df = spark.sql(
        "select explode(sequence(timestamp'2025-05-01', timestamp'2025-05-30', interval 7 hours)) as imp_timestamp"
    )
    counts = {r["split"]: r["count"] for r in with_split(df).groupBy("split").count().collect()}
    assert set(counts) == {None, "train", "val", "test"} and sum(counts.values()) == df.count()


def test_split_guard(spark):
    df = spark.createDataFrame([("test",), ("train",)], "split string")
    with pytest.raises(ValueError):
        training.require_split(df)
    assert training.require_split(df.where("split = 'test'")).count() == 1
    with pytest.raises(Exception):
        training.guarded_split(df).collect()


def test_codes_null_and_unseen(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "x string")
    assert [r["x_le"] for r in encoders.label_encode(df, ["x"]).orderBy("x_le").collect()] == [-1, 0, 1, 1]
    vocab = encoders.vocabulary([df], "x")
    other = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    got = {r["x"]: r["i"] for r in encoders.encode_vocabulary(other, "x", vocab, "i").collect()}
    assert got == {"a": 1, "z": 0, None: 3}
    clamp = spark.createDataFrame([("7",), ("-2",), ("bad",), (None,)], "x string")
    assert sorted(r["x"] for r in encoders.clamp_categories(clamp, {"x": 5}).collect()) == [0, 0, 0, 4]


def test_index_over_many_ranges(spark):
    rng = random.Random(0)
    words = sorted({f"w{rng.randrange(10**9)}" for _ in range(9000)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["i"] for r in dense_index(df, ["w"], "i", range_rows=8).collect()}  # over 1,000 ranges
    assert got == {w: i for i, w in enumerate(words)}


def test_running_totals_across_cuts(spark):
    pairs = sorted({(a, b) for a in range(20) for b in range(0, 50, 1 + a % 3)})
    df = spark.createDataFrame([(a, b, a + b) for a, b in pairs], "a bigint, b bigint, v bigint").repartition(4)
    out = global_running(df, ["a", "b"], {"v": F.col("v")}, range_rows=100)
    total, want = 0, {}
    for a, b in pairs:
        want[(a, b)] = total
        total += a + b
    assert {(r["a"], r["b"]): r["v_before"] for r in out.collect()} == want


@pytest.mark.parametrize("bins", [32, 1024])
def test_quantiles_equal_numpy(spark, bins):
    """Ties, heavy tails, both signs, neighbouring doubles, a constant and nulls."""
    rng = np.random.default_rng(bins)
    n = 1500
    columns = {
        "x": np.concatenate([np.round(rng.gamma(2.0, 10.0, n - 1000), 2), np.zeros(1000)]),
        "y": rng.integers(-2, 3, n).astype(float),
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n),
        "edge": np.concatenate([[1.7e308, -1.7e308, 5e-324, 1e-323, np.nextafter(1, 2)], np.ones(n - 5)]),
        "same": np.full(n, 4.25),
    }
    rows = [(None,) * 5, *zip(*[v.tolist() for v in columns.values()])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    qs = [0.0, 0.0001, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = scalers.exact_quantiles(df, {c_: (F.col(c_), qs) for c_ in columns}, bins=bins)
    for c_, values in columns.items():
        ordered = np.sort(values)
        for q, found in zip(qs, got[c_]):
            place = q * (n - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert found == pytest.approx(low + (high - low) * (place - np.floor(place)) if high != low else low, rel=1e-12), (c_, q)


def test_quantiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(-inf, None, nan), (-inf, None, 1.0), (1.0, None, 2.0), (3.0, None, nan), (inf, None, nan)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = scalers.exact_quantiles(df, {c_: (F.col(c_), [0.0, 0.25, 0.5, 0.75, 1.0]) for c_ in "abc"})
    assert got["a"] == [-inf, -inf, 1.0, 3.0, inf] and got["b"] == [None] * 5
    assert got["c"][:2] == [1.0, 2.0] and all(np.isnan(v) for v in got["c"][2:])
    assert scalers.exact_quantiles(df, {}) == {} and scalers.exact_quantiles(df.limit(0), {"a": (F.col("a"), [0.5])}) == {"a": [None]}


def test_scalers_constant_single_and_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (None, 5.0, 3.0)], "a double, b double, c double")
    params = scalers.fit_scalers(df, {"a": "std", "b": "log_clip_std", "c": "std"})
    rows = scalers.apply_scalers(df, params).collect()
    assert rows[0]["a"] == pytest.approx((1 - 1.5) / statistics.stdev([1, 2])) and rows[2]["a"] is None
    assert [r["b"] for r in rows] == pytest.approx([0.0] * 3)
    assert rows[2]["c"] is None  # one value has no deviation
    assert scalers.fit_target(df, "b")["scale"] == 1.0
    assert scalers.fit_normaliser(df, "b", "minmax")["scale"] == scalers.EPS


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, "x"), (5.0, "3"), (-1.0, None)], "a double, s string")
    got = df.select(c.clip("a", 0.0, 4.0).alias("c"), c.to_id("s").alias("i"), c.start_bucket(F.col("a") * 300000).alias("b")).collect()
    assert [r["c"] for r in got] == [None, 4.0, 0.0]
    assert [r["i"] for r in got] == [-1, 3, -1]
    assert [r["b"] for r in got] == [-1, 2, 0]


@pytest.mark.parametrize("positives, negatives", [(700, 6301), (5, 2), (1, 1000), (0, 9), (9, 0), (0, 0)])
def test_rebalance_keeps_the_size(spark, positives, negatives):
    rows = [(i, 1) for i in range(positives)] + [(10_000 + i, 0) for i in range(negatives)] + [(-1, None)]
    df = spark.createDataFrame(rows, "event_id bigint, is_click int")
    out = training.rebalance(df).collect()
    assert len(out) == positives + negatives
    taken = Counter(r["event_id"] for r in out)
    for label in (1, 0):
        own = [taken.get(i, 0) for i, y in rows if y == label]
        assert not own or max(own) - min(own) <= 1
        if positives and negatives:
            assert abs(sum(own) - (positives + negatives) / 2) <= 0.5
    assert len({(r["event_id"], r["copy"]) for r in out}) == len(out)


def test_sources_and_sinks(spark, tmp_path):
    df = frame(spark, log_rows(50))
    sinks.write_result(df.select("user_id", F.array("live_id", "streamer_id").alias("items")), f"{tmp_path}/r.csv", "csv")
    back = readers.load_directory(spark, str(tmp_path), {"r": "user_id bigint, items string"})["r"]
    assert back.count() == 50 and "|" in back.first()["items"]
    with pytest.raises(ValueError, match="absent"):
        require_columns(df, ["user_id", "absent"])
    with pytest.raises(ValueError):
        readers.read_table(spark, f"{tmp_path}/r.csv")
    assert shared_folder(spark)


@pytest.mark.parametrize("kind, version", [("<f8", (1, 0)), ("<f4", (2, 0)), (">i4", (1, 0)), ("<i8", (1, 0))])
def test_matrix_files_are_read_in_ranges(spark, tmp_path, kind, version):
    """Files made elsewhere: several types and header versions, an empty one, ranges that do not divide the rows."""
    rng = np.random.default_rng(1)
    parts = [np.round(rng.normal(size=(n, 5)) * 100).astype(kind) for n in (37, 0, 12)]
    (tmp_path / "m").mkdir()
    for i, part in enumerate(parts):
        with open(tmp_path / "m" / f"{i}.npy", "wb") as out:
            np.lib.format.write_array(out, part, version)
    rows = matrices.read_matrix(spark, str(tmp_path / "m"), split=7 * 5 * np.dtype(kind).itemsize)
    assert rows.rdd.getNumPartitions() == 8
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(49)) and [r["vector"] for r in got] == np.concatenate(parts).astype(float).tolist()
    one = matrices.read_matrix(spark, f"file://{tmp_path}/m/2.npy")
    assert one.count() == 12 and one.where("row = 11").first()["vector"] == parts[2][11].astype(float).tolist()


def test_matrix_files_written_and_refused(spark, tmp_path):
    df = spark.range(500).select((500 - F.col("id")).alias("k"), F.array(F.col("id") / 4, F.lit(1.0)).alias("v"))
    path = f"{tmp_path}/out"
    for _ in range(2):  # a second write replaces the first
        matrices.write_matrix(df, path, "k", "v", file=200)
        got = matrices.read_matrix(spark, path).orderBy("row").collect()
        assert [r["vector"] for r in got] == [[(499 - i) / 4, 1.0] for i in range(500)]
    assert not [p for p in (tmp_path / "out").iterdir() if not p.name.endswith(".npy")]
    uneven = df.withColumn("v", F.when(F.col("k") == 7, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="one width"):
        matrices.write_matrix(uneven, f"{tmp_path}/bad", "k", "v")
    np.save(tmp_path / "flat.npy", np.arange(3.0))
    with pytest.raises(Exception, match="matrix of numbers"):
        matrices.read_matrix(spark, str(tmp_path / "flat.npy")).count()


def test_unknown_columns_need_a_role(spark):
    df = spark.createDataFrame([(1, 2, 0.5, 3.0)], "user_id int, is_click int, ctr_user_7d double, revenue_after double")
    for read in (roles.feature_roles, roles.drop_leakage):
        with pytest.raises(ValueError, match="revenue_after"):
            read(df)
    assert roles.feature_roles(df, declared={"revenue_after": "outcome"}) == (["user_id"], ["ctr_user_7d"])
    assert roles.drop_leakage(df, declared={"revenue_after": "outcome"}).columns == ["is_click", "ctr_user_7d"]


def test_directory_of_tables(spark, tmp_path):
    folder = tmp_path / "raw" / "raw"  # a folder whose name comes twice
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{folder}/b.parquet")
    (folder / "notes.txt").write_text("x")
    for path in (str(folder), f"file://{folder}/"):
        tables = readers.load_directory(spark, path)
        assert {n: t.count() for n, t in tables.items()} == {"a": 3, "b": 4}


def test_codes_of_nothing(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x string, y int")
    assert [(r["x_le"], r["y_le"]) for r in encoders.label_encode(df, ["x", "y"]).orderBy("y").collect()] == [(-1, 0), (-1, 1)]
    for none in (df.limit(0), df.where("y > 5"), spark.createDataFrame([], df.schema)):
        assert encoders.label_encode(none, ["x", "y"]).collect() == []
        assert [r["y_le"] for r in encoders.label_encode(df, ["x", "y"], fit_on=none).collect()] == [-1, -1]
