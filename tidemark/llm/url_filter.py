"""URL allow and block lists by hashed expressions (operator 5).

A URL matches a rule (host, path) if its host is the rule's host or below it
and its path starts with the rule's path.  Each distinct URL is expanded into
the host suffixes and path prefixes that the rule set can contain, the short
hash prefix of each expression is equi-joined with the rules', and the full
digests decide.  Of the matching rules the longest expression wins, then the
longer host, then block before allow.  All of it is DataFrame work.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
a rule path matches as a plain prefix, so an empty path meets no rule whose
path is ``/``; repeated pages are each judged; without rules every URL gets the
default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, attach
from tidemark.session import materialise

RULE_SCHEMA = "host string, path string, action string"
PREFIX_DIGITS = 8
SALTS = 64
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _hashed(df: DataFrame) -> DataFrame:
    full = F.sha2(F.col("rule").cast("binary"), 256)
    return df.withColumn("_digest", full).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))


def expressions(host: str, path: str, shapes: Sequence[tuple[int, int]]) -> Column:
    """Host suffixes of k labels joined with path prefixes of n code points, for each shape (k, n) that fits."""
    labels = F.char_length(host) - F.char_length(F.translate(host, ".", "")) + 1
    fitting = [
        F.when(
            (labels >= k) & (F.char_length(path) >= n) & (F.col(host) != ""),
            F.concat(F.substring_index(F.col(host), ".", -k), F.substring(path, 1, n)),
        )
        for k, n in shapes
    ]
    return F.array_compact(F.array(*fitting))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` has (host, path, action), hosts in lower case, paths empty or
    with a leading slash.  Only its distinct shapes (host labels x path
    lengths) come to the driver: some dozens for usual lists, and bounded by
    the longest host and path in the rules.
    """
    labels = F.char_length("host") - F.char_length(F.translate("host", ".", "")) + 1
    worded = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & (F.col("host") != ""))
    shapes = [tuple(r) for r in worded.select(labels, F.char_length("path")).distinct().collect()]
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    sites = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sites = materialise(sites)
    # The same short expression comes from very many URLs: both sides carry a salt.
    salted = _hashed(sites.select("host", "path", F.explode(expressions("host", "path", sorted(shapes))).alias("rule")))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    listed = _hashed(worded.select(F.concat("host", "path").alias("rule"), "action", F.char_length("host").alias("_host")))
    listed = listed.select(
        F.col("_prefix").alias("_rule_prefix"),
        F.col("_digest").alias("_rule_digest"),
        F.col("rule").alias("_rule"),
        F.struct(
            F.char_length("rule").alias("length"),
            F.col("_host").alias("host"),
            (F.col("action") == "block").alias("block"),
            "rule",
            "action",
        ).alias("_order"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_rule_salt"),
    )
    met = salted.join(
        listed, (salted["_prefix"] == listed["_rule_prefix"]) & (salted["_salt"] == listed["_rule_salt"])
    ).where(F.col("_digest") == F.col("_rule_digest"))
    best = met.groupBy("host", "path").agg(F.max("_order").alias("_best"))
    judged = sites.join(best, ["host", "path"], "left").select(
        "host",
        "path",
        "n",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
    )
    return attach(rows, materialise(judged), ["host", "path"], "n", ["rule", "verdict"])
