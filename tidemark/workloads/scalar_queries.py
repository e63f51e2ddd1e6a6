"""Queries S1-S7 and P1-P23: scans, sinks and scalar operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions.roles import drop_leakage, feature_roles
from tidemark.operators.dedup import click_priority
from tidemark.operators.metrics import long_metrics
from tidemark.operators.ranking import top_k
from tidemark.plans.features import context_features
from tidemark.plans.splits import with_split
from tidemark.session import configure, shared_folder
from tidemark.sources import matrices, readers, sinks
from tidemark.workloads import binding as b

US = "CAST(epoch_us({}) AS BIGINT)"


def _scratch(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/results/{uuid.uuid4().hex}"


def load_tables(spark, sf):
    tables = readers.load_directory(configure(spark), sf)
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


CSV_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
}


def csv_tables(spark, sf):
    """CSV sources with declared schemas: two tables written by the sink and loaded by name."""
    folder = _scratch(spark)
    for name in CSV_SCHEMAS:
        sinks.write_result(b.table(spark, sf, name), f"{folder}/{name}.csv", "csv")
    tables = readers.load_tables(spark, {n: f"{folder}/{n}.csv" for n in CSV_SCHEMAS}, CSV_SCHEMAS, views=False)
    joined = tables["customer"].join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey")


def vectors(spark, sf):
    v = readers.read_vectors(b.table(spark, sf, "embeddings"), "vec_id", "embedding")
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return b.rounded(v.select("id", F.size("vector").alias("width"), total.alias("total")))


def matrix(spark, sf):
    """The vectors written as matrix files and read back in ranges of a few rows."""
    folder = f"{shared_folder(spark)}/matrices/{uuid.uuid4().hex}"
    matrices.write_matrix(b.table(spark, sf, "embeddings"), folder, "vec_id", "embedding", file=64 << 10)
    rows = matrices.read_matrix(spark, folder, split=20 << 10)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return b.rounded(rows.select("row", F.size("vector").alias("width"), total.alias("total")))


def flat_vectors(spark, sf):
    v = b.table(spark, sf, "embeddings").select("vec_id", "embedding")
    flat = readers.flatten_vectors(v, "embedding", 64)
    return b.rounded(flat.select("vec_id", *[F.col(f"title_emb_{i}").cast("double").alias(f"title_emb_{i}") for i in range(64)]))


def filtered_scan(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    keep = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return readers.scan_where(lines, ["l_orderkey", "l_partkey", "l_quantity"], keep)


def filter_counts(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    return readers.scan_counts(lines, F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


def plain_scan(spark, sf):
    return readers.read_table(configure(spark), f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


def split_sink(spark, sf):
    path = _scratch(spark)
    rows = with_split(click_priority(b.impressions(spark, sf)), dates=b.SPLIT)
    sinks.write_splits(rows.select("event_id", "is_click", "split"), path)
    return spark.read.parquet(path).select("event_id", "is_click", F.col("split").cast("string").alias("split"))


def result_sink(spark, sf):
    path = _scratch(spark)
    order = [F.col("watch_live_time").desc(), "live_id", "streamer_id", "event_id"]
    best = top_k(b.impressions(spark, sf), ["user_id"], order, 10)
    sinks.write_result(best.select("user_id", "rank", "event_id"), path, "csv")
    return spark.read.schema("user_id BIGINT, rank INT, event_id BIGINT").option("header", True).csv(path)


def report_sink(spark, sf):
    rates = with_split(b.impressions(spark, sf), dates=b.SPLIT).groupBy(F.col("split").alias("section")).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("is_click").alias("click_rate")
    )
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.round(F.col(m), 6).alias("value")) for m in ("rows", "click_rate")]
    )
    long = rates.select("section", F.explode(pairs).alias("s")).select("section", "s.metric", "s.value")
    path = _scratch(spark)
    sinks.write_report(long, path)
    back = spark.read.text(path).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return back.select(F.explode("m").alias("section", "v")).select("section", F.explode("v").alias("metric", "value"))


def numbers(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        c.to_number(F.substring("o_orderpriority", 1, 1), "int").alias("priority"),
        c.to_number("o_orderpriority", "double", 0.0).alias("bad_number"),
        c.to_id("o_orderstatus").alias("status_id"),
        c.to_number(F.col("o_totalprice").cast("string")).alias("price"),
    )


def times(spark, sf):
    e = b.events(spark, sf)
    ms = F.floor(F.col("t_us") / 1000)
    return e.select(
        "event_id",
        F.unix_micros(c.time_from_millis(ms)).alias("from_ms"),
        F.unix_micros(c.time_from_text(F.col("imp_timestamp").cast("string"))).alias("from_text"),
        F.unix_micros(c.time_from_text("event_type")).alias("from_bad"),
        F.date_format(c.date_from_int(F.date_format("imp_timestamp", "yyyyMMdd").cast("int")), "yyyy-MM-dd").alias("day"),
    )


def prefixed(spark, sf):
    named = b.table(spark, sf, "customer").withColumnsRenamed({"c_nationkey": "country", "c_mktsegment": "age"})
    return c.rename_prefixed(named, ["country", "age", "absent"], "user_")


def calendar(spark, sf):
    e = b.events(spark, sf)
    return e.select("event_id", *c.calendar_parts("imp_timestamp", "imp"))


def build_dates(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    day = c.date_from_parts(F.year("l_shipdate"), F.col("l_linenumber") * 2, F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", F.date_format(day, "yyyy-MM-dd").alias("day"))


SPEC = ["user [id]", "l_partkey", "l_suppkey", "l_partkey", "absent", "l_quantity"]
ALIASES = {"user [id]": "l_orderkey"}


def spec_projection(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    return c.select_spec(lines, SPEC, ALIASES).withColumn("missing", F.lit(",".join(c.missing_spec(lines, SPEC, ALIASES))))


def clipped(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    some = F.nullif(F.col("l_quantity"), F.lit(7.0))
    return lines.select("l_orderkey", "l_quantity", c.clip(some, 10.0, 40.0).alias("clipped"))


def started(spark, sf):
    """Impressions with a start time per live and hour; lives of category 2 have none."""
    e = b.impressions(spark, sf)
    start = F.when(F.col("live_content_category_le") != 2, c.micros(F.date_trunc("hour", F.col("imp_timestamp").cast("timestamp"))))
    base = F.lit(1672531200000000).cast("bigint")
    return e.withColumns(
        {
            "start_us": start,
            "user_reg_us": base + F.col("user_id") * 3_600_000_000,
            "streamer_reg_us": base + F.col("streamer_id") * 86_400_000_000,
        }
    )


STARTED = (
    b.IMP
    + """,
started AS (
  SELECT imp.*, CASE WHEN cat <> 2 THEN epoch_us(date_trunc('hour', ts)) END AS start_us,
         1672531200000000 + user_id * 3600000000 AS user_reg_us,
         1672531200000000 + streamer_id * 86400000000 AS streamer_reg_us FROM imp)"""
)


def start_bucket(spark, sf):
    out = context_features(started(spark, sf))
    return out.select("event_id", "time_since_start_live_bucket")


def ages(spark, sf):
    out = context_features(started(spark, sf))
    return b.rounded(
        out.select("event_id", "user_account_age", "streamer_account_age", "time_since_live_start", "time_since_start_live")
    )


def contrast(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    return b.rounded(
        lines.select(
            "l_orderkey",
            c.log_contrast(F.col("l_discount"), F.col("l_tax"), 1e-6).alias("trend"),
            c.log_contrast(F.log1p("l_quantity"), F.log1p("l_extendedprice"), 1.0).alias("amount_trend"),
        )
    )


def cold_start(spark, sf):
    out = started(spark, sf)
    since = c.elapsed("t_us", "start_us", "ms")
    return b.rounded(out.select("event_id", c.fill(since, 604800000.0).alias("since"), c.missing_flag(since).alias("since_missing")))


def labels(spark, sf):
    raw = b.impressions(spark, sf).withColumn("watch_live_time", F.col("watch_live_time") - 5.0)
    out = c.multitask_labels(raw)
    return b.rounded(out.select("event_id", "is_click", "watch_live_time", "watch_greater_30s", "watch_live_time_log"))


def ratios(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    a, d = F.col("l_tax"), F.col("l_discount")
    return b.rounded(
        lines.select("l_orderkey", c.ratio(a, d).alias("safe"), c.smoothed_rate(a, d).alias("smoothed"))
    )


def splits(spark, sf):
    return with_split(b.impressions(spark, sf), dates=b.SPLIT).select("event_id", "split")


def keys(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    return lines.select("l_orderkey", c.item_key("l_partkey", F.nullif(F.col("l_suppkey"), F.lit(5))).alias("item_key"))


def roles(spark, sf):
    e = b.interactions(spark, sf).withColumns(
        {
            "user_gender_le": F.col("user_id") % 2,
            "tslc_missing": F.lit(0),
            "empty": F.lit(None).cast("double"),
        }
    )
    categories, nums = feature_roles(e, disable_ids=True, declared={"empty": "number"})
    rows = [(x, "categorical") for x in categories] + [(x, "numeric") for x in nums]
    return spark.createDataFrame(rows, "column string, role string")


ROLE_ROWS = [
    *[(x, "categorical") for x in ("imp_year", "imp_month", "imp_day", "imp_hour", "imp_is_weekend", "live_content_category_le")],
    ("user_gender_le", "numeric"),
]


def recent_items(spark, sf):
    lines = b.table(spark, sf, "lineitem")
    kept = lines.where(
        c.recent(F.col("l_shipdate").cast("date"), "1998-06-30", 14) & c.allowed_or_unknown("l_linenumber", [1, 2, 3])
    )
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


def scores(spark, sf):
    s = scored_impressions(spark, sf)
    names = ["score_ctr", "score_watch_greater_30s", "score_like"]
    weights = dict(zip(names, (1.0, 0.5, 2.0)))
    return b.rounded(
        s.select("event_id", c.mean_score(*names).alias("mean_score"), c.weighted_relevance(weights).alias("relevance"))
    )


def scored_impressions(spark, sf, labels: bool = False):
    """Impressions with task labels and repeatable scores that lean towards the labels."""
    base = b.interactions(spark, sf) if labels else b.impressions(spark, sf)
    base = c.multitask_labels(base)
    h = lambda tag: c.hash_fraction("event_id", seed=tag)
    like = F.col("is_like") if labels else F.lit(0)
    return base.withColumns(
        {
            "score_ctr": F.round(h("ctr") * 0.8 + F.col("is_click") * 0.2, 3),
            "score_watch_greater_30s": F.round(h("watch") * 0.7 + F.col("watch_greater_30s") * 0.3, 3),
            "score_like": F.round(h("like") * 0.9 + like * 0.1, 3),
            "score_watch_live_time_log": F.round(h("time") * 6.0, 3),
        }
    )


def _h(tag: str) -> str:
    return f"(('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|{tag}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def scored_sql(source: str, like: str) -> str:
    return f""",
scored0 AS (
  SELECT *, CASE WHEN watch_live_time >= 30 THEN 1 ELSE 0 END AS watch_greater_30s,
         ln(1 + watch_live_time) AS watch_live_time_log FROM {source}),
scored AS (
  SELECT *, round({_h('ctr')} * 0.8::DOUBLE + is_click * 0.2::DOUBLE, 3) AS score_ctr,
         round({_h('watch')} * 0.7::DOUBLE + watch_greater_30s * 0.3::DOUBLE, 3) AS score_watch_greater_30s,
         round({_h('like')} * 0.9::DOUBLE + {like} * 0.1::DOUBLE, 3) AS score_like,
         round({_h('time')} * 6.0::DOUBLE, 3) AS score_watch_live_time_log FROM scored0)"""


SCORED = b.IMP + scored_sql("imp", "0")
SCORED_LABELS = b.INTER + scored_sql("inter", "is_like")


def unscaled(spark, sf):
    s = scored_impressions(spark, sf)
    return b.rounded(
        s.select("event_id", c.unscale_watch(F.col("score_watch_live_time_log") - 3.0, 2.0, 4.0).alias("watch"))
    )


def sampled(spark, sf):
    return c.repeatable_sample(b.events(spark, sf), 0.1, "event_id", seed=7).select("event_id", "user_id")


def log_transforms(spark, sf):
    cust = b.table(spark, sf, "customer")
    low = cust.agg(F.min("c_acctbal").alias("m")).first()["m"]
    return b.rounded(
        cust.select(
            "c_custkey",
            c.log_shifted("c_acctbal", low).alias("log1p"),
            c.log_shifted("c_acctbal", low, "log").alias("log"),
            c.logit(F.col("c_acctbal") / 10000.0).alias("logit"),
        )
    )


def filled(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_discount"), F.lit(0.05)).alias("d"), F.col("l_returnflag").alias("f")
    )
    return c.fill_block(lines, ["d", "f", "absent"])


def complete_rows(spark, sf):
    e = b.events(spark, sf).withColumn("live_id", F.when(F.col("event_type") != "view", F.col("live_id").cast("string")).otherwise("bad"))
    return c.drop_incomplete(e, ["user_id", "live_id"], "t_us").select("event_id", "live_id")


def leakage_free(spark, sf):
    e = b.interactions(spark, sf).withColumn("consecutive_skips_user", F.lit(1))
    safe = drop_leakage(e)
    counts = safe.agg(*[F.count(x).alias(x) for x in safe.columns])
    return long_metrics(counts).select(F.col("metric").alias("column"), F.col("value").cast("bigint").alias("non_null"))


QUERIES = {
    "S1_load_tables": load_tables,
    "S1_csv_tables": csv_tables,
    "S2_vectors": vectors,
    "S2_flat_vectors": flat_vectors,
    "S2_matrix": matrix,
    "S3_filtered_scan": filtered_scan,
    "S3_scan_counts": filter_counts,
    "S4_plain_scan": plain_scan,
    "S5_split_sink": split_sink,
    "S6_result_sink": result_sink,
    "S7_metric_report": report_sink,
    "P1_numbers": numbers,
    "P2_times": times,
    "P3_prefix": prefixed,
    "P4_calendar": calendar,
    "P5_dates": build_dates,
    "P6_spec": spec_projection,
    "P7_clip": clipped,
    "P8_start_bucket": start_bucket,
    "P9_ages": ages,
    "P10_trend": contrast,
    "P11_cold_start": cold_start,
    "P12_labels": labels,
    "P13_ratio": ratios,
    "P14_split": splits,
    "P15_item_key": keys,
    "P16_roles": roles,
    "P17_predicates": recent_items,
    "P18_scores": scores,
    "P19_unscale": unscaled,
    "P20_sample": sampled,
    "P21_log_logit": log_transforms,
    "P22_fill": filled,
    "P23_complete": complete_rows,
    "R7_leakage_guard": leakage_free,
}

_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
_A4 = (
    "row_number() OVER (PARTITION BY live_id, streamer_id, user_id ORDER BY is_click DESC, "
    "CASE WHEN is_click = 1 THEN t_us ELSE -t_us END NULLS LAST, event_id) = 1"
)
_MS = "(t_us - start_us) / 1e3"

SQL = {
    "S1_load_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _TABLES),
    "S1_csv_tables": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "S2_vectors": "SELECT vec_id AS id, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings",
    "S2_matrix": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, len(embedding) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings",
    "S2_flat_vectors": "SELECT vec_id, " + ", ".join(
        f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS title_emb_{i}" for i in range(64)) + " FROM embeddings",
    "S3_filtered_scan": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
    "S3_scan_counts": "SELECT count(*) AS rows_scanned, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS rows_kept FROM lineitem",
    "S4_plain_scan": "SELECT o_orderkey, o_totalprice FROM orders",
    "S5_split_sink": f"WITH {b.IMP} SELECT event_id, is_click, split FROM (SELECT *, {b.split_sql('ts')} AS split FROM imp QUALIFY {_A4}) WHERE split IS NOT NULL",
    "S6_result_sink": f"WITH {b.IMP} SELECT user_id, rank, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY watch_live_time DESC, live_id, streamer_id, event_id) AS rank FROM imp) WHERE rank <= 10",
    "S7_metric_report": f"WITH {b.IMP}, r AS (SELECT {b.split_sql('ts')} AS section, count(*)::DOUBLE AS rows, avg(is_click) AS click_rate FROM imp GROUP BY 1) SELECT section, 'rows' AS metric, rows AS value FROM r UNION ALL SELECT section, 'click_rate', round(click_rate, 6) FROM r",
    "P1_numbers": "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, coalesce(TRY_CAST(o_orderpriority AS DOUBLE), 0) AS bad_number, coalesce(TRY_CAST(o_orderstatus AS BIGINT), -1) AS status_id, o_totalprice AS price FROM orders",
    "P2_times": f"WITH {b.EV} SELECT event_id, t_us // 1000 * 1000 AS from_ms, t_us AS from_text, CAST(NULL AS BIGINT) AS from_bad, strftime(ts, '%Y-%m-%d') AS day FROM ev",
    "P3_prefix": "SELECT c_custkey, c_name, c_nationkey AS user_country, c_acctbal, c_mktsegment AS user_age FROM customer",
    "P4_calendar": "SELECT event_id, year(ts) AS imp_year, month(ts) AS imp_month, day(ts) AS imp_day, hour(ts) AS imp_hour, CAST(isodow(ts) >= 6 AS INTEGER) AS imp_is_weekend FROM events",
    "P5_dates": "SELECT l_orderkey, l_linenumber, l_quantity, strftime(TRY_CAST(printf('%04d-%02d-%02d', year(l_shipdate), CAST(l_linenumber * 2 AS BIGINT), CAST(l_quantity AS BIGINT)) AS DATE), '%Y-%m-%d') AS day FROM lineitem",
    "P6_spec": "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, 'absent' AS missing FROM lineitem",
    "P7_clip": "SELECT l_orderkey, l_quantity, CASE WHEN nullif(l_quantity, 7) < 10 THEN 10 WHEN nullif(l_quantity, 7) > 40 THEN 40 ELSE nullif(l_quantity, 7) END AS clipped FROM lineitem",
    "P8_start_bucket": f"WITH {STARTED} SELECT event_id, CASE WHEN start_us IS NULL THEN -1 WHEN {_MS} <= 300000 THEN 0 WHEN {_MS} <= 1200000 THEN 1 ELSE 2 END AS time_since_start_live_bucket FROM started",
    "P9_ages": f"WITH {STARTED} SELECT event_id, round((t_us - user_reg_us) / 8.64e10, 6) AS user_account_age, round((t_us - streamer_reg_us) / 8.64e10, 6) AS streamer_account_age, round({_MS}, 6) AS time_since_live_start, round({_MS}, 6) AS time_since_start_live FROM started",
    "P10_trend": "SELECT l_orderkey, round(ln(l_discount + 1e-6) - ln(l_tax + 1e-6), 6) + 0.0 AS trend, round(ln(ln(1 + l_quantity) + 1) - ln(ln(1 + l_extendedprice) + 1), 6) + 0.0 AS amount_trend FROM lineitem",
    "P11_cold_start": f"WITH {STARTED} SELECT event_id, round(coalesce({_MS}, 604800000), 6) AS since, CAST(start_us IS NULL AS INTEGER) AS since_missing FROM started",
    "P12_labels": f"WITH {b.IMP}, x AS (SELECT event_id, is_click, greatest(watch_live_time - 5, 0) AS w5 FROM imp) SELECT event_id, is_click, round(w5, 6) AS watch_live_time, CAST(w5 >= 30 AS INTEGER) AS watch_greater_30s, round(ln(1 + w5), 6) AS watch_live_time_log FROM x",
    "P13_ratio": "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_tax / l_discount, 6) END AS safe, round((l_tax + 1) / (l_discount + 1), 6) AS smoothed FROM lineitem",
    "P14_split": f"WITH {b.IMP} SELECT event_id, {b.split_sql('ts')} AS split FROM imp",
    "P15_item_key": "SELECT l_orderkey, CAST(l_partkey AS VARCHAR) || '_' || CAST(coalesce(nullif(l_suppkey, 5), -1) AS VARCHAR) AS item_key FROM lineitem",
    "P16_roles": "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{r}')" for x, r in ROLE_ROWS) + ") t(\"column\", role) WHERE (SELECT count(*) FROM events) > 0",
    "P17_predicates": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-06-16' AND DATE '1998-06-30' AND (l_linenumber IS NULL OR l_linenumber IN (1, 2, 3))",
    "P18_scores": f"WITH {SCORED} SELECT event_id, round((score_ctr + score_watch_greater_30s + score_like) / 3, 6) AS mean_score, round(score_ctr + 0.5 * score_watch_greater_30s + 2 * score_like, 6) AS relevance FROM scored",
    "P19_unscale": f"WITH {SCORED} SELECT event_id, round(exp(greatest(least((score_watch_live_time_log - 3) * 4 + 2, 12), -5)) - 1, 6) + 0.0 AS watch FROM scored",
    "P20_sample": f"WITH {b.EV} SELECT event_id, user_id FROM ev WHERE {_h('7')} < 0.1",
    "P21_log_logit": "WITH m AS (SELECT *, c_acctbal + greatest(-(SELECT min(c_acctbal) FROM customer), 0) AS s, least(greatest(c_acctbal / 10000, 1e-6), 1 - 1e-6) AS p FROM customer) SELECT c_custkey, round(ln(1 + s), 6) + 0.0 AS log1p, round(ln(nullif(s, 0)), 6) + 0.0 AS log, round(ln(p / (1 - p)), 6) + 0.0 AS logit FROM m",
    "P22_fill": "SELECT l_orderkey, coalesce(nullif(l_discount, 0.05), 0) AS d, 0.0::DOUBLE AS f FROM lineitem",
    "P23_complete": f"WITH {b.EV} SELECT event_id, live_id FROM ev WHERE event_type <> 'view'",
    "R7_leakage_guard": f"WITH {b.INTER} SELECT t.* FROM (SELECT count(*) AS n, count(cat) AS nc FROM inter) s, LATERAL (VALUES ('is_click', n), ('watch_live_time', n), ('is_like', n), ('imp_year', n), ('imp_month', n), ('imp_day', n), ('imp_hour', n), ('imp_is_weekend', n), ('live_content_category_le', nc)) t(\"column\", non_null)",
}
