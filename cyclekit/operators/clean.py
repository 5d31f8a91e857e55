"""Cleaning: sentinels, spikes, gaps, ramps, range rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import null_sentinel_col, ramp_value
from ..schema import (INPUT_BOUNDS, NO3_ABSOLUTE_THRESHOLD, NO3_SPIKE_STD_THRESHOLD,
                      NO3_SPIKE_WINDOW, SENTINEL_VALUE, STEP_MINUTES, VALID_REACTORS)
from .series import POS, SeriesSpec, block_scan, block_window, ensure_position, own_rows, with_halo


def null_sentinel(df: DataFrame, cols: list[str], sentinel=SENTINEL_VALUE) -> DataFrame:
    """Replace the sentinel value by null in ``cols``."""
    return df.withColumns({c: null_sentinel_col(c, sentinel) for c in cols})


def bad_ts_count(df: DataFrame, ts: str) -> DataFrame:
    """One-row table with the number of unparsed timestamps."""
    return df.agg(F.count(F.when(F.col(ts).isNull(), 1)).cast("long").alias("bad_ts"))


def require_parsed(df: DataFrame, ts: str) -> DataFrame:
    """Raise with the count of unparsed timestamps; returns ``df`` unchanged."""
    n = bad_ts_count(df, ts).first()["bad_ts"]
    if n:
        raise ValueError(f"{n} rows have an unparsed {ts}")
    return df


def centered_exprs(spec: SeriesSpec, col: str, window: int = NO3_SPIKE_WINDOW, med: str = "_med",
                   std: str = "_std") -> dict[str, Column]:
    """W8 columns over a frame with ``window // 2`` halo rows on each side."""
    half = window // 2
    w = block_window(spec).rowsBetween(-half, half)
    return {med: F.percentile(F.col(col), F.lit(0.5)).over(w),
            std: F.coalesce(F.stddev_samp(F.col(col)).over(w), F.lit(1.0))}


def centered_stats(df: DataFrame, spec: SeriesSpec, col: str, window: int = NO3_SPIKE_WINDOW,
                   med: str = "_med", std: str = "_std") -> DataFrame:
    """Centered rolling median and sample std over ``window`` rows (min 1 value);
    a missing std becomes 1."""
    half = window // 2
    df = ensure_position(df, spec)
    h = with_halo(df, spec, before=half, after=half)
    return own_rows(h.withColumns(centered_exprs(spec, col, window, med, std)))


def despike_finish(df: DataFrame, col: str, k: float = NO3_SPIKE_STD_THRESHOLD,
                   abs_threshold: float | None = NO3_ABSOLUTE_THRESHOLD) -> DataFrame:
    """W9 rule on precomputed ``_med``/``_std``: null where |x - median| > k * std
    or x > abs_threshold."""
    x = F.col(col)
    spike = F.abs(x - F.col("_med")) > F.lit(k) * F.col("_std")
    if abs_threshold is not None:
        spike = spike | (x > F.lit(abs_threshold))
    return df.withColumn(col, F.when(~F.coalesce(spike, F.lit(False)), x)).drop("_med", "_std")


def despike(df: DataFrame, spec: SeriesSpec, col: str = "no3", window: int = NO3_SPIKE_WINDOW,
            k: float = NO3_SPIKE_STD_THRESHOLD, abs_threshold: float | None = NO3_ABSOLUTE_THRESHOLD) -> DataFrame:
    """Null where |x - median| > k * std, or x > abs_threshold."""
    return despike_finish(centered_stats(df, spec, col, window), col, k, abs_threshold)


def interp_scan(cols: list[str]) -> tuple[dict, dict]:
    """``block_scan`` arguments (lasts, nexts) for ``interp_finish``."""
    return ({f"_ip_{c}": F.col(c) for c in cols}, {f"_in_{c}": F.col(c) for c in cols})


def interp_finish(df: DataFrame, cols: list[str]) -> DataFrame:
    """Linear formula by row position between the carried neighbours; edges take
    the nearest known value."""
    out = {}
    for c in cols:
        prev, nxt = F.col(f"_ip_{c}"), F.col(f"_in_{c}")
        slope = (nxt["v"] - prev["v"]) / (nxt["p"] - prev["p"]).cast("double")
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                  .when(prev.isNotNull() & nxt.isNotNull(), slope * (F.col(POS) - prev["p"]) + prev["v"])
                  .when(prev.isNotNull(), prev["v"])
                  .otherwise(nxt["v"]))
    return df.withColumns(out).drop(*[f"_ip_{c}" for c in cols], *[f"_in_{c}" for c in cols])


def interpolate_linear(df: DataFrame, spec: SeriesSpec, cols: list[str]) -> DataFrame:
    """Linear interpolation by row position inside each key; leading and
    trailing gaps take the nearest known value."""
    df = ensure_position(df, spec)
    lasts, nexts = interp_scan(cols)
    return interp_finish(block_scan(df, spec, lasts=lasts, nexts=nexts), cols)


def rename_to_contract(df: DataFrame, fields: dict[str, str], whole: tuple[str, ...] = ("weekday", "elapsed_time", "reactor")) -> DataFrame:
    """The fields of a request under the names of a feature contract (``fields``: field -> feature,
    in contract order), coerced to numbers: ``whole`` features to integers, the others to
    doubles. What is no number becomes null; an absent field is an error. Other columns go."""
    missing = [c for c in fields if c not in df.columns]
    if missing:
        raise KeyError(f"fields missing: {missing}")
    kinds = {f: "bigint" if f in whole else "double" for f in fields.values()}
    return df.select(*[F.expr(f"try_cast(`{c}` AS {kinds[f]})").alias(f) for c, f in fields.items()])


def impute_ramp(df: DataFrame, ts: str, config: dict[str, tuple[float, float]], month: int,
                span_days: int) -> DataFrame:
    """On rows of ``month``, overwrite each column with a linear day ramp."""
    in_month = F.month(F.col(ts)) == F.lit(month)
    return df.withColumns({c: F.when(in_month, ramp_value(ts, v0, v1, span_days)).otherwise(F.col(c))
                           for c, (v0, v1) in config.items()})


def range_rules(bounds: dict = INPUT_BOUNDS, reactor_col: str | None = "reactor",
                valid_reactors: list[str] = VALID_REACTORS, elapsed_col: str | None = "elapsed_time",
                step: int = STEP_MINUTES) -> list[tuple[str, Column]]:
    """P14 rules as (name, violated) pairs; a missing value violates its rule."""
    rules = []
    for c, (lo, hi) in bounds.items():
        v = F.col(c)
        bad = v.isNull()
        if lo is not None:
            bad = bad | (v < F.lit(lo))
        if hi is not None:
            bad = bad | (v > F.lit(hi))
        rules.append((f"{c}_range", bad))
    if elapsed_col:
        e = F.col(elapsed_col)
        rules.append((f"{elapsed_col}_step", e.isNull() | (F.pmod(e, F.lit(step)) != 0)))
    if reactor_col:
        r = F.col(reactor_col)
        rules.append((f"{reactor_col}_allowed", r.isNull() | ~r.isin(*valid_reactors)))
    return rules


def validate_rows(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """One pass adding ``violations`` (array of failed rule names) and ``is_valid``."""
    names = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])
    v = F.filter(names, lambda x: x.isNotNull())
    return df.withColumn("violations", v).withColumn("is_valid", F.size(v) == 0)
