"""Leak-free time-series features.

Within-run windows use the block layout of ``series``: a halo of the previous
block's last rows is enough because every frame here looks back at most
``WINDOW_SIZE - 1`` rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (do_saturation, encode_category, guarded_ratio, hour_cos, hour_sin,
                                hour_of, weekday_of)
from ..schema import SCALER_CLIP, STEP_MINUTES, WINDOW_SIZE
from .series import POS, SeriesSpec, block_window, own_rows, with_halo

ROLLING_ROWS = 6
DECAY_LAG = 3


def run_features(df: DataFrame, spec: SeriesSpec, run_col: str = "run_id", step: int = STEP_MINUTES) -> DataFrame:
    """W5-W7 in one window pass: nh4/no3/ph diffs, nh4 decay rate over 3 rows,
    trailing 6-row nh4 mean (nulls skipped, min 1 value). All restart per run."""
    h = with_halo(df, spec, before=ROLLING_ROWS - 1)
    w = block_window(spec, run_col)
    roll = w.rowsBetween(-(ROLLING_ROWS - 1), 0)
    h = h.withColumns({
        "nh4_diff": F.coalesce(F.col("nh4") - F.lag("nh4", 1).over(w), F.lit(0.0)),
        "no3_diff": F.coalesce(F.col("no3") - F.lag("no3", 1).over(w), F.lit(0.0)),
        "ph_diff": F.coalesce(F.col("ph") - F.lag("ph", 1).over(w), F.lit(0.0)),
        "nh4_decay_rate": F.coalesce(F.col("nh4") - F.lag("nh4", DECAY_LAG).over(w), F.lit(0.0))
        / F.lit(float(DECAY_LAG * step)),
        "nh4_rolling_mean": F.avg("nh4").over(roll),
    })
    return own_rows(h)


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """F1-F2: hour, weekday (Mon = 0) and the cyclic hour encoding."""
    return (df.withColumn("hour", hour_of(ts)).withColumn("weekday", weekday_of(ts))
              .withColumn("hour_sin", hour_sin("hour")).withColumn("hour_cos", hour_cos("hour")))


def ratio_features(df: DataFrame) -> DataFrame:
    """Guarded nh4/no3 ratio and dissolved-oxygen saturation."""
    return (df.withColumn("nh4_no3_ratio", guarded_ratio("nh4", "no3"))
              .withColumn("do_saturation", do_saturation("temp")))


def add_reactor_code(df: DataFrame, name_col: str, order: list[str], out: str = "reactor") -> DataFrame:
    """Fixed label order, alphabetical like a label encoder."""
    return df.withColumn(out, encode_category(name_col, sorted(order)))


def sliding_sequences(df: DataFrame, spec: SeriesSpec, features: list[str], size: int = WINDOW_SIZE,
                      run_col: str = "cycle_no", out: str = "window") -> DataFrame:
    """One window of the last ``size`` rows (features as a struct per step)
    for every row that has ``size`` rows of its run behind it. Structs keep nulls."""
    h = with_halo(df, spec, before=size - 1)
    w = block_window(spec, run_col).rowsBetween(-(size - 1), 0)
    step = F.struct(F.col(POS).alias("p"), *[F.col(c).alias(c) for c in features])
    h = h.withColumn(out, F.collect_list(step).over(w))
    return own_rows(h).filter(F.size(out) == size)


def window_matrix(df: DataFrame, window_col: str, features: list[str], out: str = "flat") -> DataFrame:
    """Flatten a window of structs into ``size * len(features)`` float values."""
    flat = F.flatten(F.transform(F.col(window_col),
                                 lambda s: F.array(*[s[c].cast("float") for c in features])))
    return df.withColumn(out, flat)


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """A13 fit: mean and population std per column; a zero std becomes 1.
    Returns a small dict of model parameters (two numbers per column)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (float(m) if m is not None else 0.0, float(s) if s else 1.0)
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]], clip: float | None = SCALER_CLIP,
                 suffix: str = "") -> DataFrame:
    """A13 transform: (x - mean) / std, optionally clipped to +-clip."""
    out = {}
    for c, (m, s) in params.items():
        z = (F.col(c) - F.lit(m)) / F.lit(s)
        if clip is not None:
            z = F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))
        out[f"{c}{suffix}"] = z
    return df.withColumns(out)
