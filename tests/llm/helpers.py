"""Small document frames with nulls, ties, repeats and clashing column names."""

from __future__ import annotations

import random

CLASHING = "keep_id bigint, digest string, size bigint, key string, score double, held_out string, uid string, target string"
#: Names that operators use, or used, for columns of their own.
INNER = "_id _kept _row _digest _chars _absent _words _nth _copy _copies _d _n whole row mark copies absent root part node"
CLASHING += "".join(f", {name} int" for name in INNER.split())
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def frame(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, lang[, source]]) as documents with extra columns whose names the operators use inside."""
    wide = [(r + (None,) * (4 - len(r)))[:4] + (len(r[1] or ""), 7, "x", 1, "k", 0.5, "h", "u", "t", *range(len(INNER.split()))) for r in rows]
    return spark.createDataFrame(wide, schema)


def words(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD_TEXTS = [None, "", " \t\n\x0b\x0c\r", "a", "A", " a ", "é Ü", "\U0001f600 \U0001f600", "a\u00a0b", "x" * 30_000, "one two " * 5_000]


def odd_rows(start: int = 0):
    """Each odd text twice, one row repeated whole, one without an id."""
    rows = [(start + i, t, "en", "s") for i, t in enumerate(ODD_TEXTS + ODD_TEXTS)]
    return [*rows, rows[3], (None, "no id here", None, None)]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
