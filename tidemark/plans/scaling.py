"""Which transform each feature gets, and the whole scaling stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.functions.columns import clip
from tidemark.operators.scalers import apply_scalers, fit_normaliser, fit_scalers, normalise
from tidemark.plans.features import family_columns

ZSCORE = ["user_account_age", "user_watch_live_age"]
LOG_STD = ["time_since_live_start", "time_since_start_live", "streamer_account_age", "streamer_live_age"]
STD = [
    f"{stat}_watch_time_{subject}"
    for subject in ("live", "live_30min", "streamer")
    for stat in ("avg", "median")
]
UNTOUCHED = {"pct_long_watch_user_30s", "pct_long_watch_live_60s_30min", "pct_long_watch_streamer_30s"}


def method_of(column: str) -> str | None:
    """Transform of one feature by its naming rule; None leaves it as it is."""
    if column in ZSCORE:
        return "zscore"
    if column in LOG_STD:
        return "log_std"
    if column in STD:
        return "std"
    if column in UNTOUCHED or column.startswith("has_") or column.endswith(("_missing", "_bucket")):
        return None
    if "_trend_" in column:
        return "clip_std"
    if column.startswith("ctr_") or "_rate_" in column:
        return "unit"
    if column.startswith(("num_", "amount_", "time_since_", "avg_", "median_", "consecutive_")):
        return "log_clip_std"
    return None


def feature_methods(columns: Sequence[str]) -> dict[str, str]:
    return {c: m for c in columns if (m := method_of(c)) is not None}


def all_feature_columns() -> list[str]:
    from tidemark.plans.features import FAMILIES

    return [*family_columns(FAMILIES), *ZSCORE, *LOG_STD]


def scale_features(df: DataFrame, fit_on: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default: the table itself) and transform every known feature column."""
    methods = feature_methods([c for c in (columns or all_feature_columns()) if c in df.columns])
    fitted = fit_on if fit_on is not None else df
    scaled = apply_scalers(
        df, fit_scalers(fitted, {c: m for c, m in methods.items() if m not in ("unit", "zscore")})
    )
    for c, m in methods.items():
        if m == "zscore":
            scaled = scaled.withColumn(c, normalise(c, fit_normaliser(fitted, c)))
    return scaled.withColumns({c: clip(c, 0.0, 1.0) for c, m in methods.items() if m == "unit"})
