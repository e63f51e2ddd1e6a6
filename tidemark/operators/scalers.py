"""Distribution-fitted scaling (E4-E10, A7): fit a few numbers per column, then project.

``fit`` runs a fixed number of passes for all columns together and returns a
small dictionary; applying it is a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clip

#: Parts that a bracket is cut into by one pass.
BINS = 4096
EPS = 1e-9


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], bins: int = BINS
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation for many columns at once (A7), by radix selection.

    Each wanted rank lies in a bracket of values.  A pass over the narrow
    columns cuts all brackets into ``bins`` parts, counts the rows of each part
    and keeps the part that holds the rank, with its least and greatest value as
    the new bracket, until they are equal.  The first pass cuts a sixth root of
    roots, so that it tells magnitudes apart whatever the range; both keys rise
    with the value also after rounding, so no row is counted on the wrong side.
    A pass separates at least the ends of each bracket, and in general leaves
    one row in ``bins``, so a few passes do at any size, and what comes back is
    ``bins`` counts for each bracket.  Infinities and NaN, the greatest, have
    their places; nulls have none.
    """
    if not wanted:
        return {}
    table = df.select(*[e.cast("double").alias(f"c{i}") for i, (e, _) in enumerate(wanted.values())])
    places = range(len(wanted))
    ends = (float("-inf"), float("inf"), float("nan"))
    finite = lambda i: F.when((F.col(f"c{i}") > ends[0]) & (F.col(f"c{i}") < ends[1]), F.col(f"c{i}"))
    row = table.agg(
        *[F.count_if(F.col(f"c{i}") == F.lit(v)).alias(f"n{i}_{j}") for i in places for j, v in enumerate(ends)],
        *[F.count(finite(i)).alias(f"n{i}") for i in places],
        *[f(finite(i)).alias(f"{name}{i}") for i in places for name, f in (("low", F.min), ("high", F.max))],
    ).first()
    # Ranks among the finite values, by column; the others are known already.
    value: dict[tuple[int, int], float] = {}
    brackets: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
    asked: dict[tuple[int, float], tuple[int, int, float]] = {}
    for i, (_, qs) in enumerate(wanted.values()):
        below, inner = row[f"n{i}_0"], row[f"n{i}"]
        total = below + inner + row[f"n{i}_1"] + row[f"n{i}_2"]
        for q in qs if total else ():
            position = q * (total - 1)
            asked[i, q] = (math.floor(position), math.ceil(position), position - math.floor(position))
            for rank in asked[i, q][:2]:
                if below <= rank < below + inner:
                    brackets.setdefault((i, row[f"low{i}"], row[f"high{i}"]), []).append((rank, rank - below))
                else:
                    value[i, rank] = ends[0] if rank < below else ends[1] if rank < below + inner + row[f"n{i}_1"] else ends[2]
    first = True
    while brackets:
        for known in [k for k in brackets if k[1] == k[2]]:
            value.update({(known[0], rank): known[1] for rank, _ in brackets.pop(known)})
        if brackets:
            brackets = _narrowed(table, brackets, bins, first)
        first = False
    out = {}
    for i, (c, (_, qs)) in enumerate(wanted.items()):
        out[c] = [_between(*[value[i, r] for r in asked[i, q][:2]], asked[i, q][2]) if (i, q) in asked else None for q in qs]
    return out


def _between(low: float, high: float, part: float) -> float:
    return low if part == 0 or low == high else low + (high - low) * part


def _rooted(x: Column) -> Column:
    """A square root six times over, with the sign."""
    root = F.abs(x)
    for _ in range(6):
        root = F.sqrt(root)
    return F.when(x < 0, -root).otherwise(root)


def _narrowed(table: DataFrame, brackets: dict, bins: int, rooted: bool) -> dict:
    """The parts of the brackets (column, least, greatest) that hold their ranks (rank, place in the bracket)."""
    key = _rooted if rooted else lambda x: x
    parts = []
    for number, (i, low, high) in enumerate(brackets):
        x = F.col(f"c{i}")
        low_key, high_key = key(F.lit(low)), key(F.lit(high))
        if math.isinf(high - low):  # halves, so that the difference of two large numbers stays finite
            share = (key(x) / 2 - low_key / 2) / (high_key / 2 - low_key / 2)
        else:
            share = (key(x) - low_key) / (high_key - low_key)
        same = low_key == high_key  # different values may have one root
        part = F.when(same, F.lit(0)).otherwise(F.least(F.floor(F.when(~same, share) * bins), F.lit(bins - 1)))
        inside = (x >= low) & (x <= high)
        parts.append(F.when(inside, F.struct(F.lit(number).alias("number"), part.cast("int").alias("part"), x.alias("x"))))
    cells = table.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).groupBy("p.number", "p.part")
    counted = cells.agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("low"), F.max("p.x").alias("high")).collect()
    held: dict[int, list] = {}
    for r in counted:
        held.setdefault(r["number"], []).append((r["part"], r["n"], r["low"], r["high"]))
    out: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
    for number, ((i, _, _), ranks) in enumerate(brackets.items()):
        before, waiting = 0, sorted(set(ranks), key=lambda r: r[1])
        for _, n, low, high in sorted(held[number]):
            while waiting and waiting[0][1] < before + n:
                rank, place = waiting.pop(0)
                out.setdefault((i, low, high), []).append((rank, place - before))
            before += n
    return out


# How each method treats a value before it is centred: (log1p of non-negative, lower and upper clip quantile).
METHODS = {
    "log_clip_std": (True, None, 0.99),
    "clip_std": (False, 0.01, 0.99),
    "log_std": (True, None, None),
    "std": (False, None, None),
}


def _raw(column: str, method: str) -> Column:
    value = F.col(column).cast("double")
    return F.log1p(clip(value, 0.0)) if METHODS[method][0] else value


def _bounded(column: str, method: str, p: Mapping) -> Column:
    return clip(_raw(column, method), p.get("low"), p.get("high"))


def fit_scalers(df: DataFrame, methods: Mapping[str, str], **options) -> dict[str, dict]:
    """Clip bounds, mean and sample deviation per column."""
    asked = {}
    for c, m in methods.items():
        qs = [q for q in METHODS[m][1:] if q is not None]
        if qs:
            asked[c] = (_raw(c, m), qs)
    quantiles = exact_quantiles(df, asked, **options)
    params: dict[str, dict] = {}
    for c, m in methods.items():
        names = [n for n, q in zip(("low", "high"), METHODS[m][1:]) if q is not None]
        params[c] = {"method": m, **dict(zip(names, quantiles.get(c, [])))}
    if not methods:
        return params
    row = df.agg(
        *[F.avg(_bounded(c, m, params[c])).alias(f"m{i}") for i, (c, m) in enumerate(methods.items())],
        *[F.stddev_samp(_bounded(c, m, params[c])).alias(f"s{i}") for i, (c, m) in enumerate(methods.items())],
    ).first()
    for i, c in enumerate(methods):
        std = row[f"s{i}"]
        params[c] |= {"mean": row[f"m{i}"], "std": 1.0 if std == 0 else std}
    return params


def apply_scalers(df: DataFrame, params: Mapping[str, dict]) -> DataFrame:
    """Projection with fitted numbers; a column without a deviation becomes null."""
    out = {}
    for c, p in params.items():
        if p["std"] is None or p["mean"] is None:
            out[c] = F.lit(None).cast("double")
        else:
            out[c] = (_bounded(c, p["method"], p) - F.lit(p["mean"])) / F.lit(p["std"])
    return df.withColumns(out)


def fit_normaliser(
    df: DataFrame, column: str, method: str = "zscore", clip_q: float | None = None, eps: float = EPS, **options
) -> dict:
    """Parameters of one z-score, min-max or robust scaling."""
    value, params = F.col(column).cast("double"), {"method": method}
    if clip_q is not None:
        low, high = exact_quantiles(df, {column: (value, [1 - clip_q, clip_q])}, **options)[column]
        params |= {"low": low, "high": high}
        value = clip(value, low, high)
    if method == "zscore":
        row = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
        std = row["s"] if row["s"] is not None and row["s"] > eps else eps
        return params | {"center": row["m"], "scale": std}
    if method == "minmax":
        row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        span = (row["hi"] or 0.0) - (row["lo"] or 0.0)
        return params | {"center": row["lo"], "scale": span if span > eps else eps}
    if method == "robust":
        q1, med, q3 = exact_quantiles(df, {column: (value, [0.25, 0.5, 0.75])}, **options)[column]
        iqr = (q3 or 0.0) - (q1 or 0.0)
        return params | {"center": med, "scale": iqr if iqr > eps else eps}
    raise ValueError("method must be one of: 'zscore', 'minmax', 'robust'")


def normalise(column: str, params: Mapping) -> Column:
    value = clip(F.col(column).cast("double"), params.get("low"), params.get("high"))
    return (value - F.lit(params["center"])) / F.lit(params["scale"])


def fit_target(train: DataFrame, column: str) -> dict:
    """Train mean and population deviation; a constant target keeps its scale."""
    row = train.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    return {"center": row["m"], "scale": row["s"] if row["s"] and row["s"] > 0 else 1.0}


def fit_minmax(df: DataFrame, columns: Mapping[str, Column]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value of several expressions in one pass."""
    row = df.agg(
        *[F.min(e).alias(f"lo_{n}") for n, e in columns.items()], *[F.max(e).alias(f"hi_{n}") for n, e in columns.items()]
    ).first()
    return {n: (row[f"lo_{n}"], row[f"hi_{n}"]) for n in columns}


def unit_range(value: Column, bounds: tuple[float | None, float | None]) -> Column:
    """Min-max to [0, 1], constant to 0."""
    low, high = bounds
    if low is None or high <= low:
        return F.lit(0.0)
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low))


def unit_range_by(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Min-max within each key, constant to 0 (E10); the bounds are combined before the shuffle."""
    bounds = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col(column) - F.col("_lo")) / span).otherwise(F.lit(0.0))
    return df.join(bounds, list(keys), "left").select(*[df[c] for c in df.columns], scaled.alias(out))
