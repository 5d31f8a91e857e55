"""Control signal and batch back-test.

The per-row predictor loop of the source system becomes columns over the
block layout: buffer resets and fill levels are carried across blocks by
``block_scan``; the start prediction is forward-filled along the cycle the same
way, so no join on a (possibly huge) cycle id is needed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp_signal, clip_nonneg, start_floor, stop_flag, was_clamped
from ..schema import LSTM_WINDOW_THRESHOLD, MAX_T_SIGNAL, MIN_T_SIGNAL, STOP_THRESHOLD, WINDOW_SIZE
from .series import POS, SeriesSpec, block_scan, block_window, join_small, materialize, own_rows, with_halo

XGB_ONLY = "xgb_only"
INTEGRATED = "integrated"


def base_remaining(start_pred, elapsed) -> Column:
    """max(0, start prediction - elapsed)."""
    s = F.col(start_pred) if isinstance(start_pred, str) else start_pred
    e = F.col(elapsed) if isinstance(elapsed, str) else elapsed
    return F.greatest(F.lit(0), s - e)


def choose_mode(elapsed, buffer_fill, threshold: int = LSTM_WINDOW_THRESHOLD, size: int = WINDOW_SIZE) -> Column:
    """xgb_only until elapsed >= threshold and the buffer is full."""
    e = F.col(elapsed) if isinstance(elapsed, str) else elapsed
    b = F.col(buffer_fill) if isinstance(buffer_fill, str) else buffer_fill
    return F.when((e < F.lit(threshold)) | (b < F.lit(size)), F.lit(XGB_ONLY)).otherwise(F.lit(INTEGRATED))


def combine(mode, base, step_pred) -> Column:
    """xgb_only -> base; integrated -> max(base, max(0, step prediction))."""
    m = F.col(mode) if isinstance(mode, str) else mode
    b = (F.col(base) if isinstance(base, str) else base).cast("double")
    return F.when(m == F.lit(XGB_ONLY), b).otherwise(F.greatest(b, clip_nonneg(step_pred)))


def signal_columns(df: DataFrame, start_pred: str = "start_pred", elapsed: str = "elapsed_time",
                   buffer_fill: str = "buffer_fill", step_pred: str = "step_pred") -> DataFrame:
    """C1-C4 + F5 as columns: base, mode, raw signal, t_signal, was_clamped, should_continue."""
    d = df.withColumn("base_remaining", base_remaining(start_pred, elapsed))
    d = d.withColumn("mode", choose_mode(elapsed, buffer_fill))
    d = d.withColumn("raw_signal", combine("mode", "base_remaining", step_pred))
    return (d.withColumn("t_signal", clamp_signal("raw_signal", MIN_T_SIGNAL, MAX_T_SIGNAL))
             .withColumn("was_clamped", was_clamped("raw_signal", MIN_T_SIGNAL, MAX_T_SIGNAL))
             .withColumn("should_continue", stop_flag("t_signal", STOP_THRESHOLD)))


def buffer_state(df: DataFrame, spec: SeriesSpec, cycle: str = "cycle_no", elapsed: str = "elapsed_time",
                 size: int = WINDOW_SIZE) -> DataFrame:
    """A buffer restarts at every cycle start and whenever elapsed
    decreases; ``segment_no`` counts restarts, ``buffer_fill`` = min(size, rows
    since the restart)."""
    h = with_halo(df, spec, before=1)
    w = block_window(spec)
    h = h.withColumn("_pc", F.lag(cycle).over(w)).withColumn("_pe", F.lag(elapsed).over(w))
    d = own_rows(h)
    reset = (F.col(POS) == 1) | ~F.col("_pc").eqNullSafe(F.col(cycle)) | (F.col(elapsed) < F.col("_pe"))
    d = d.withColumn("_reset", reset)
    d = block_scan(d, spec, sums={"segment_no": F.col("_reset").cast("long")},
                   lasts={"_rp": F.when(F.col("_reset"), F.col(POS))})
    fill = F.least(F.lit(size), (F.col(POS) - F.col("_rp.p") + 1).cast("int"))
    return d.withColumn("buffer_fill", fill).drop("_pc", "_pe", "_reset", "_rp")


def carry_start(df: DataFrame, spec: SeriesSpec, cycle: str, value_cols: list[str],
                start_flag: str | None = None) -> DataFrame:
    """Forward-fill the values set on a cycle's start row over the whole cycle
    (scalar carries, hash-aggregatable). Rows whose cycle start has no values get
    nulls. ``start_flag`` marks cycle starts; by default the first row of each
    ``cycle`` value is found by comparing with the carried cycle."""
    present = F.col(value_cols[0]).isNotNull()
    lasts = {f"_cv_{v}": F.when(present, F.col(v)) for v in value_cols}
    lasts["_cc"] = F.when(present, F.col(cycle))
    d = block_scan(df, spec, lasts=lasts)
    same = F.col("_cc.v") == F.col(cycle)
    return (d.withColumns({v: F.when(same, F.col(f"_cv_{v}.v")) for v in value_cols})
             .drop("_cc", *[f"_cv_{v}" for v in value_cols]))


def first_stop(steps: DataFrame, keys: list[str], cycle: str = "cycle_no", signal: str = "t_signal",
               threshold: int = STOP_THRESHOLD, elapsed: str = "elapsed_time", nh4: str = "nh4") -> DataFrame:
    """Per cycle, elapsed and nh4 at the first row with signal <= threshold
    (null when none). Grouped ``min_by`` with scalar buffers: hash-based partial
    aggregation."""
    at = F.when(F.col(signal) <= F.lit(threshold), F.col(POS))
    return steps.groupBy(*keys, cycle).agg(F.min_by(elapsed, at).alias("stop_elapsed"),
                                           F.min_by(nh4, at).alias("stop_nh4"))


def current_history(steps: DataFrame, spec: SeriesSpec, cycle: str = "cycle_no") -> DataFrame:
    """Log rows of the latest cycle per key, with predicted end = elapsed + signal.
    The key's latest cycle comes from a per-block aggregate combined over the
    key's blocks (``key_totals``), so rows are never shuffled by key alone.
    Returned as rows (not one array) so no group is gathered into one value."""
    from .series import key_totals
    d = key_totals(steps, spec, {"_latest": ("max", F.col(cycle))})
    d = d.filter(F.col(cycle) == F.col("_latest")).drop("_latest")
    return d.withColumn("predicted_end_time", F.col("elapsed_time") + F.col("t_signal"))


def _matched_starts(d: DataFrame, starts: DataFrame, spec: SeriesSpec, start_pred_col: str) -> DataFrame:
    """Attach each cycle's start record to its start row: equi-join on (keys, start time),
    first record by the tie-break columns."""
    from .joins import dedupe_first
    from .series import BLK
    keys, ts = list(spec.keys), spec.order[0]
    s = starts.select(*keys, F.col(ts).alias("_sts"), *spec.order[1:],
                      start_floor(start_pred_col).alias("_start_pred"), F.col("cycle_runtime").alias("_actual"))
    s = dedupe_first(s, keys + ["_sts"], list(spec.order[1:]) or ["_start_pred"])
    first = d.filter(F.col("_start")).select(*keys, BLK, POS, F.col(ts).alias("_sts"))
    matched = first.join(s.select(*keys, "_sts", "_start_pred", "_actual"), on=keys + ["_sts"]).drop("_sts")
    return join_small(d, matched, keys + [BLK, POS], "left")


def replay(steps: DataFrame, starts: DataFrame | None, spec: SeriesSpec, start_pred_col: str | Column,
           step_pred: Column, flag: str = "current_aeration", elapsed: str = "elapsed_time",
           checkpoint: bool = False, dedupe_repeats: bool = False) -> DataFrame:
    """Full batch back-test without a row loop.

    steps:  step table (all rows, with the series positions of the build); on-rows
            are replayed. A cycle starts at every on-row with elapsed = 0.
    starts: start table (one row per cycle start, keyed by spec.keys + start time)
            with the start model's raw prediction in ``start_pred_col`` and the
            cycle's actual runtime in ``cycle_runtime``. None: the step table's own start
            rows are the start records, ``start_pred_col`` is then an expression on them.
            Cycles without a prediction (null, NaN) are skipped, see ``skipped_cycles``.
    step_pred: column expression of the step model's prediction for a row.

    One halo pass gives the previous row's elapsed; one carry scan gives the
    cycle number, buffer restarts, the last restart and the cycle's matched start
    record. Rows of a cycle are contiguous in the series and every cycle start is
    a restart, so the full series' previous row is the right one wherever it
    matters. Returns one row per replayed step (cycles without a start record are
    skipped). ``dedupe_repeats`` drops a repeated tick (an on-row with the same
    non-zero elapsed as the previous on-row) and renumbers first; by default a
    repeat is appended to the buffer again, as in the source system."""
    from .series import BLK, ensure_position, with_position

    d = ensure_position(steps.drop("run_pos", "run_rows"), spec)
    if dedupe_repeats:
        w = block_window(spec)
        h = with_halo(d, spec, before=1)
        h = h.withColumns({"_pe0": F.lag(elapsed).over(w), "_pf0": F.lag(flag).over(w)})
        rep = ((F.col(flag) == 1) & (F.col("_pf0") == 1) & (F.col(elapsed) != 0)
               & (F.col(elapsed) == F.col("_pe0")))
        d = own_rows(h).filter(~F.coalesce(rep, F.lit(False))).drop("_pe0", "_pf0", POS, BLK)
        d = with_position(d, spec)
    h = with_halo(d, spec, before=1)
    d = own_rows(h.withColumn("_pe", F.lag(elapsed).over(block_window(spec))))
    on = F.col(flag) == 1
    is_start = on & (F.col(elapsed) == 0)
    reset = is_start | (on & (F.col(elapsed) < F.col("_pe")))
    d = d.withColumn("_start", is_start).withColumn("_reset", reset).drop("_pe")

    if starts is None:
        pred = start_floor(start_pred_col)
        d = d.withColumns({"_start_pred": F.when(is_start, pred), "_actual": F.when(is_start, F.col("cycle_runtime"))})
    else:
        d = _matched_starts(d, starts, spec, start_pred_col)

    d = block_scan(d, spec,
                   sums={"cycle_no": F.col("_start").cast("long"), "segment_no": F.col("_reset").cast("long")},
                   lasts={"_rp": F.when(F.col("_reset"), F.col(POS)),
                          "_cs": F.when(F.col("_start"), F.col(POS)),
                          # scalar carries (hash-aggregatable); both sit on the matched start row
                          "_sp": F.when(F.col("_start_pred").isNotNull(), F.col("_start_pred")),
                          "_ac": F.when(F.col("_start_pred").isNotNull(), F.col("_actual"))})
    same = on & (F.col("_sp.p") == F.col("_cs.p"))
    d = (d.filter(same)
          .withColumns({"start_pred": F.col("_sp.v"), "actual_runtime": F.col("_ac.v"),
                        "buffer_fill": F.least(F.lit(WINDOW_SIZE), (F.col(POS) - F.col("_rp.p") + 1).cast("int"))})
          .drop("_rp", "_cs", "_sp", "_ac", "_start", "_reset", "_start_pred", "_actual"))
    d = d.withColumn("step_pred", step_pred)
    return materialize(signal_columns(d, "start_pred", elapsed, "buffer_fill", "step_pred"), checkpoint)


def cycle_outcomes(replayed: DataFrame, keys: list[str], cycle: str = "cycle_no") -> DataFrame:
    """Per replayed cycle: actual runtime, stop elapsed and nh4 at stop."""
    at = F.when(F.col("t_signal") <= F.lit(STOP_THRESHOLD), F.col(POS))
    return replayed.groupBy(*keys, cycle).agg(
        F.max("actual_runtime").alias("actual_runtime"), F.min_by("elapsed_time", at).alias("stop_elapsed"),
        F.min_by("nh4", at).alias("stop_nh4"))


def skipped_cycles(starts: DataFrame, start_pred: str) -> DataFrame:
    """One row: how many cycle starts have a prediction and how many are skipped for want of one."""
    p = start_floor(start_pred)
    return starts.agg(F.count(p).cast("long").alias("n_replayed"),
                      F.count(F.when(p.isNull(), 1)).cast("long").alias("n_skipped"))
