"""Cycles: on-flag, run segmentation and per-cycle tables (P8-P11, W1-W4, W11, W16, A1, SO2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import threshold_flag_col
from ..schema import STEP_MINUTES
from .series import POS, SeriesSpec, block_scan, ensure_position, key_totals, segment_runs


def add_flag(df: DataFrame, value_col: str, threshold: float, out: str = "current_aeration") -> DataFrame:
    """On-flag = value > threshold; missing/NaN = 0."""
    return df.withColumn(out, threshold_flag_col(value_col, threshold))


def cycle_finish(df: DataFrame, flag: str = "current_aeration", step: int = STEP_MINUTES) -> DataFrame:
    """W2-W4 from run_pos / run_rows: cycle_runtime (run rows x step on on-runs,
    else 0), elapsed_time (position in run x step x flag), T_remaining."""
    f = F.col(flag)
    runtime = F.when(f == 1, F.col("run_rows") * step).otherwise(0).cast("int")
    elapsed = (F.col("run_pos") * step * f).cast("int")
    return df.withColumns({"cycle_runtime": runtime, "elapsed_time": elapsed,
                           "T_remaining": (runtime - elapsed).cast("int")})


def cycle_columns(df: DataFrame, spec: SeriesSpec, flag: str = "current_aeration",
                  step: int = STEP_MINUTES) -> DataFrame:
    """run_id, cycle_runtime, elapsed_time, T_remaining."""
    return cycle_finish(segment_runs(ensure_position(df, spec), spec, flag, prefix="run"), flag, step)


def active_rows(df: DataFrame, flag: str = "current_aeration", runtime: str = "cycle_runtime") -> DataFrame:
    """On-rows; also drops on-rows with zero runtime (never true after W2)."""
    f = F.col(flag)
    return df.filter(~((F.col(runtime) == 0) & (f == 1))).filter(f == 1)


def cycle_starts(df: DataFrame, features: list[str], target: str, elapsed: str = "elapsed_time") -> DataFrame:
    """P10: rows with elapsed = 0 and every feature and the target present."""
    if elapsed not in df.columns:
        raise KeyError(f"{elapsed} missing - run cycle_columns first")
    return df.filter(F.col(elapsed) == 0).na.drop(subset=list(features) + [target])


def split_by_time(df: DataFrame, ts: str, boundary: str, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """train = ts < boundary, test = ts >= boundary; error if a side is empty."""
    b = F.lit(boundary).cast("timestamp_ntz")
    train, test = df.filter(F.col(ts) < b), df.filter(F.col(ts) >= b)
    if check and (not train.limit(1).count() or not test.limit(1).count()):
        raise ValueError("time split left one side empty")
    return train, test


def split_label(df: DataFrame, ts: str, boundary: str, out: str = "split") -> DataFrame:
    """P11 as a column: 'train' / 'test' (null timestamps stay null)."""
    b = F.lit(boundary).cast("timestamp_ntz")
    return df.withColumn(out, F.when(F.col(ts) < b, "train").when(F.col(ts) >= b, "test"))


def cycle_summary(df: DataFrame, keys: list[str], ts: str, run_col: str = "run_id",
                  flag: str = "current_aeration", step: int = STEP_MINUTES, on_only: bool = True) -> DataFrame:
    """A1: per run: start, end, rows and runtime = rows x step. Partial
    aggregation keeps a hot run cheap."""
    d = df.filter(F.col(flag) == 1) if on_only else df
    return (d.groupBy(*keys, run_col)
             .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
                  F.count(F.lit(1)).alias("n_rows"))
             .withColumn("runtime_min", (F.col("n_rows") * step).cast("long")))


def start_counter_id(df: DataFrame, spec: SeriesSpec, elapsed: str = "elapsed_time",
                     out: str = "cycle_no") -> DataFrame:
    """Running count of cycle starts (elapsed = 0) per key."""
    df = ensure_position(df, spec)
    return block_scan(df, spec, sums={out: (F.col(elapsed) == 0).cast("long")})


def run_cycle_no(df: DataFrame, flag: str = "current_aeration", run_col: str = "run_id", out: str = "cycle_no") -> DataFrame:
    """W11 for a built step table, without a scan: on- and off-runs alternate, so an on-run's number
    gives its place among the on-runs. Off-rows have none. Not for runs that a time gap may
    end (``segment_runs(max_gap_seconds=...)``): use ``start_counter_id`` there."""
    return df.withColumn(out, F.when(F.col(flag) == 1, F.expr(f"(`{run_col}` + 1) div 2")))


def split_cycle_id(df: DataFrame, spec: SeriesSpec, split: str, first: str, cycle: str = "cycle_no") -> DataFrame:
    """W11's ids of two splits that never collide: adds ``split_no``, the running count of cycle starts
    within (key, split), for the composite id (key, split, split_no). ``cycle`` is the running count
    over the whole key, ``first`` the value of ``split`` that comes first; rows of the other split
    before its first start have 0 and belong to no cycle of it."""
    own = F.when(F.col(split) == F.lit(first), F.col(cycle))
    d = key_totals(df, spec, {"_before": ("max", own)})
    base = F.when(F.col(split) == F.lit(first), F.lit(0)).otherwise(F.coalesce("_before", F.lit(0)))
    return d.withColumn("split_no", F.col(cycle) - base).drop("_before")


def cycle_first_row(df: DataFrame, keys: list[str], cycle: str, order: list[str]) -> DataFrame:
    """First row of every cycle as a grouped aggregate (partial aggregation)
    — no window over a possibly huge cycle."""
    from .joins import first_by
    return first_by(df, list(keys) + [cycle], list(order))


def longest_cycle(cycles: DataFrame, keys: list[str], n_col: str, start_col: str,
                  pred_col: str | None = None, min_pred: float | None = None) -> DataFrame:
    """SO2: per key, the cycle with the most rows (earliest start wins ties),
    optionally among cycles whose start prediction >= min_pred. ``cycles`` has
    one row per cycle, so the window is over cycles, not rows."""
    d = cycles
    if pred_col is not None and min_pred is not None:
        d = d.filter(F.col(pred_col) >= F.lit(min_pred))
    # grouped min over (-n, start, row): partial aggregation, no window over a key's cycles
    payload = [c for c in d.columns if c not in keys]
    best = d.groupBy(*keys).agg(F.min(F.struct((-F.col(n_col)).alias("_n"), F.col(start_col).alias("_s"),
                                                F.struct(*payload).alias("_row"))).alias("_m"))
    return best.select(*keys, "_m._row.*")


__all__ = ["add_flag", "cycle_finish", "cycle_columns", "active_rows", "cycle_starts", "split_by_time", "split_label",
           "cycle_summary", "start_counter_id", "run_cycle_no", "split_cycle_id", "cycle_first_row", "longest_cycle", "POS"]
