"""Error, safety and energy indicators (A2-A12, A15). Each is one aggregation
with conditional aggregates; Spark does the partial/final split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (EARLY_STOP_MARGIN, KRW_PER_KWH, LATE_STAGE_MIN, LSTM_WINDOW_THRESHOLD,
                      NH4_SAFETY_THRESHOLD, STAGES, TARGETS, TEST_MONTH_DAYS,
                      UNDERPREDICTION_MARGIN, aerator_kwh_per_min)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def error_metrics(df: DataFrame, pred, truth, group: list[str] | None = None) -> DataFrame:
    """A2: MAE, RMSE and n (optionally per group)."""
    d = _c(pred).cast("double") - _c(truth).cast("double")
    aggs = [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
            F.count(d).cast("long").alias("n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def underprediction_rate(df: DataFrame, pred, truth, margin: int = UNDERPREDICTION_MARGIN,
                         group: list[str] | None = None) -> DataFrame:
    """A3: share of rows with pred < truth - margin (strict)."""
    hit = (_c(pred) < _c(truth) - F.lit(margin)).cast("double")
    agg = F.avg(hit).alias("underprediction_rate")
    return df.groupBy(*group).agg(agg) if group else df.agg(agg)


def stage_column(elapsed, stages=STAGES) -> Column:
    """Stage label by inclusive elapsed ranges; outside every range -> null."""
    e = _c(elapsed)
    expr = None
    for label, lo, hi in stages:
        cond = (e >= F.lit(lo)) & (e <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def stage_metrics(df: DataFrame, pred, truth, elapsed, group: list[str] | None = None) -> DataFrame:
    """A4: MAE/RMSE/n per elapsed stage; an empty stage is absent."""
    g = list(group or [])
    d = df.withColumn("stage", stage_column(elapsed)).filter(F.col("stage").isNotNull())
    return error_metrics(d, pred, truth, g + ["stage"])


def late_stage_metrics(df: DataFrame, pred, truth, elapsed, group: list[str] | None = None) -> DataFrame:
    """A5: MAE/RMSE on elapsed >= 91 and on elapsed >= 60; null (not 0) if empty."""
    d = _c(pred).cast("double") - _c(truth).cast("double")
    e = _c(elapsed)
    aggs = []
    for name, lo in (("late", LATE_STAGE_MIN), ("integrated", LSTM_WINDOW_THRESHOLD)):
        m = e >= F.lit(lo)
        aggs += [F.avg(F.when(m, F.abs(d))).alias(f"{name}_mae"),
                 F.sqrt(F.avg(F.when(m, d * d))).alias(f"{name}_rmse"),
                 F.count(F.when(m, d)).cast("long").alias(f"{name}_n")]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def mode_counts(df: DataFrame, elapsed="elapsed_time", clamped="was_clamped",
                threshold: int = LSTM_WINDOW_THRESHOLD) -> DataFrame:
    """Steps before/after the threshold and clamped steps in each."""
    phase = F.when(_c(elapsed) < F.lit(threshold), F.lit("xgb_only")).otherwise(F.lit("integrated"))
    return (df.groupBy(phase.alias("phase"))
              .agg(F.count(F.lit(1)).cast("long").alias("n_steps"),
                   F.sum(_c(clamped).cast("long")).cast("long").alias("n_clamped")))


def stop_kpis(cycles: DataFrame, actual="actual_runtime", stop="stop_elapsed", nh4="stop_nh4",
              group: list[str] | None = None) -> DataFrame:
    """A7 over one row per matched cycle (stop null = never stopped):
    no_stop_rate (all cycles); avg_time_saved, unsafe_early_stop_rate, avg_overrun,
    nh4_risk_rate (stopped cycles; 0 when none stopped)."""
    a, s = _c(actual).cast("double"), _c(stop).cast("double")
    diff = a - s
    stopped = s.isNotNull()
    aggs = [
        F.count(F.lit(1)).cast("long").alias("n_cycles"),
        F.count(s).cast("long").alias("n_stopped"),
        F.avg((~stopped).cast("double")).alias("no_stop_rate"),
        F.coalesce(F.avg(diff), F.lit(0.0)).alias("avg_time_saved"),
        F.coalesce(F.avg(F.when(stopped, (diff > F.lit(EARLY_STOP_MARGIN)).cast("double"))), F.lit(0.0))
        .alias("unsafe_early_stop_rate"),
        F.coalesce(F.avg(F.when(stopped, F.greatest(F.lit(0.0), -diff))), F.lit(0.0)).alias("avg_overrun"),
        F.coalesce(F.avg(F.when(stopped, (_c(nh4) > F.lit(NH4_SAFETY_THRESHOLD)).cast("double"))), F.lit(0.0))
        .alias("nh4_risk_rate"),
    ]
    return cycles.groupBy(*group).agg(*aggs) if group else cycles.agg(*aggs)


def energy_savings(cycles: DataFrame, actual="actual_runtime", stop="stop_elapsed",
                   days: int = TEST_MONTH_DAYS, group: list[str] | None = None) -> DataFrame:
    """Simulated stop = coalesce(stop, actual); minutes saved scaled to a
    year (x 365 / days), converted to kWh and KRW."""
    a = _c(actual).cast("double")
    sim = F.coalesce(_c(stop).cast("double"), a)
    saved = F.sum(a - sim)
    kwh = saved * F.lit(365.0 / days) * F.lit(aerator_kwh_per_min())
    aggs = [F.count(F.lit(1)).cast("long").alias("test_cycles"),
            F.avg(a).alias("actual_avg_min"), F.avg(sim).alias("sim_stop_avg_min"),
            saved.alias("saved_min"), kwh.alias("saved_kwh_annual"),
            (kwh * F.lit(KRW_PER_KWH)).alias("saved_krw_annual")]
    return cycles.groupBy(*group).agg(*aggs) if group else cycles.agg(*aggs)


def target_check(metrics: DataFrame, kind: str, mae="mae", rmse="rmse") -> DataFrame:
    """Pass flags against the fixed targets; a missing value fails."""
    mt, rt = TARGETS[kind]
    return (metrics.withColumn("mae_pass", F.coalesce(_c(mae) < F.lit(mt), F.lit(False)))
                   .withColumn("rmse_pass", F.coalesce(_c(rmse) < F.lit(rt), F.lit(False))))


def describe(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """A10: count, mean, sample std, min, quartiles, max. Exact quartiles
    (linear interpolation) keep one count per distinct value in the buffer,
    cheap for runtimes (multiples of 10 minutes); ``exact=False`` uses
    ``percentile_approx`` for continuous columns at scale."""
    c = F.col(col).cast("double")
    if exact:
        qs = [F.percentile(c, F.lit(p)) for p in (0.25, 0.5, 0.75)]
    else:
        qs = [F.percentile_approx(c, F.lit(p), F.lit(10_000)).cast("double") for p in (0.25, 0.5, 0.75)]
    return df.agg(F.count(c).cast("long").alias("count"), F.avg(c).alias("mean"),
                  F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                  qs[0].alias("p25"), qs[1].alias("p50"), qs[2].alias("p75"), F.max(c).alias("max"))


def samples_per_month(df: DataFrame, ts: str, split: str = "split") -> DataFrame:
    """Rows per (split, month) with totals per split and overall (GROUPING
    SETS), plus first/last timestamp."""
    d = df.select(F.col(split).alias("split"), F.month(ts).alias("month"), F.col(ts).alias("_ts"))
    return (d.groupingSets([["split", "month"], ["split"], []], "split", "month")
             .agg(F.grouping_id("split", "month").alias("level"), F.count(F.lit(1)).cast("long").alias("n"),
                  F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts")))


def table_summary(df: DataFrame, key: str, remaining: str | None = "T_remaining") -> DataFrame:
    """Rows per key, total nulls over every column, negative remaining time.
    Returned per key plus a grand total row (key null) via ROLLUP."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum(nulls).cast("long").alias("n_nulls")]
    if remaining:
        aggs.append(F.count(F.when(F.col(remaining) < 0, 1)).cast("long").alias("n_negative_remaining"))
    return df.rollup(key).agg(*aggs)


def end_quantile(df: DataFrame, keys: list[str], run_col: str, pos_col: str, value: str,
                 q: float = 0.95, exact: bool = True) -> DataFrame:
    """Quantile of ``value`` at the last row of every run (exact
    ``percentile`` or ``percentile_approx`` at scale)."""
    last = df.groupBy(*keys, run_col).agg(F.max_by(F.col(value), F.col(pos_col)).alias("_l"))
    v = F.col("_l")
    if exact:
        agg = F.percentile(v, F.lit(q))
    else:
        agg = F.percentile_approx(v, F.lit(q), F.lit(10_000)).cast("double")
    return last.agg(F.count(v).cast("long").alias("n_runs"), agg.alias("quantile"))
