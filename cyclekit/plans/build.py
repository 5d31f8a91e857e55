"""ML7: the end-to-end feature build as one lazy plan.

aligned rows -> sentinels -> no3 spikes -> interpolation -> on-flag -> runs
(W1-W4) -> run features (W5-W7) -> calendar/ratio features. Output is the
step table (all rows); ``cycle_table`` keeps on-rows and adds the reactor code."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.scalar import nan_to_null
from ..operators.clean import centered_exprs, despike_finish, interp_finish, interp_scan, null_sentinel
from ..operators.cycles import active_rows, add_flag, cycle_finish
from ..operators.features import add_reactor_code, calendar_features, ratio_features, run_features
from ..operators.series import (SeriesSpec, block_scan, materialize, own_rows, run_boundaries,
                                run_finish, run_scan, with_halo, with_position)
from ..schema import (AERATION_CURRENT_THRESHOLD, INTERP_COLS, NO3_ABSOLUTE_THRESHOLD,
                      NO3_SPIKE_STD_THRESHOLD, NO3_SPIKE_WINDOW, SENTINEL_COLS, SENTINEL_VALUE,
                      STEP_MINUTES, VALID_REACTORS)


@dataclass(frozen=True)
class BuildOptions:
    """Settings of the feature build, see ``build_dataset``."""
    current_col: str = "current_r"
    threshold: float = AERATION_CURRENT_THRESHOLD
    sentinel_cols: tuple[str, ...] = tuple(SENTINEL_COLS)
    sentinel: float = SENTINEL_VALUE
    spike_k: float = NO3_SPIKE_STD_THRESHOLD
    spike_abs: float | None = NO3_ABSOLUTE_THRESHOLD
    interp_cols: tuple[str, ...] = tuple(INTERP_COLS)
    clean_temp_first: bool = False
    clean_no3_sentinel: bool = False
    step: int = STEP_MINUTES


def flagged(aligned: DataFrame, o: BuildOptions) -> DataFrame:
    """Row-wise part: NaN and sentinels become null, the on-flag is set."""
    measured = sorted({"nh4", "no3", "ph", "temp", o.current_col, *o.interp_cols} & set(aligned.columns))
    d = aligned.withColumns({c: nan_to_null(c) for c in measured})      # NaN is a missing value
    cols = list(o.sentinel_cols) + (["no3"] if o.clean_no3_sentinel else []) + (["temp"] if o.clean_temp_first else [])
    return add_flag(null_sentinel(d, cols, o.sentinel), o.current_col, o.threshold)


def despiked(d: DataFrame, spec: SeriesSpec, o: BuildOptions) -> DataFrame:
    """One halo exchange serves the centered no3 stats (W8, +-2 rows) and the run
    boundaries (W1, +-1 row): the on-flag comes from the raw current, so runs
    need not wait for cleaning."""
    half = NO3_SPIKE_WINDOW // 2
    h = with_halo(d, spec, before=half, after=half)
    d = own_rows(h.withColumns({**centered_exprs(spec, "no3", NO3_SPIKE_WINDOW),
                                **run_boundaries("current_aeration", spec)}))
    return despike_finish(d, "no3", o.spike_k, o.spike_abs)


def scanned(d: DataFrame, spec: SeriesSpec, o: BuildOptions) -> DataFrame:
    """One carry scan serves interpolation (W10) and run ids / bounds."""
    i_lasts, i_nexts = interp_scan(list(o.interp_cols))
    r_sums, r_lasts, r_nexts = run_scan("run")
    return block_scan(d, spec, sums=r_sums, lasts={**i_lasts, **r_lasts}, nexts={**i_nexts, **r_nexts})


def segmented(d: DataFrame, o: BuildOptions) -> DataFrame:
    d = run_finish(interp_finish(d, list(o.interp_cols)), "run")
    return cycle_finish(d, "current_aeration", o.step)


def featured(d: DataFrame, spec: SeriesSpec, o: BuildOptions) -> DataFrame:
    return ratio_features(calendar_features(run_features(d, spec, "run_id", o.step), spec.order[0]))


def build_dataset(aligned: DataFrame, spec: SeriesSpec, current_col: str = "current_r",
                  threshold: float = AERATION_CURRENT_THRESHOLD, sentinel_cols: list[str] = SENTINEL_COLS,
                  sentinel=SENTINEL_VALUE, spike_k: float = NO3_SPIKE_STD_THRESHOLD,
                  spike_abs: float | None = NO3_ABSOLUTE_THRESHOLD, interp_cols: list[str] = INTERP_COLS,
                  clean_temp_first: bool = False, clean_no3_sentinel: bool = False,
                  step: int = STEP_MINUTES, checkpoint: bool = False, staged: bool = False) -> DataFrame:
    """Step feature table. ``aligned`` has spec.keys, spec.order, nh4, no3, ph,
    temp and ``current_col``; NaN counts as missing. One lazy plan: nothing is written
    unless ``checkpoint=True`` asks for the cleaned series and the final table as stage
    tables in the shared checkpoint folder, which a caller with many uses of the step
    table wants. Options: ``clean_temp_first`` (V4: temp sentinel
    nulled before do_saturation) and ``clean_no3_sentinel`` (V5). ``staged=True`` writes the
    despiked series alone: the carry scan reads it twice and would else number, sort and clean
    the whole source twice."""
    o = BuildOptions(current_col, threshold, tuple(sentinel_cols), sentinel, spike_k, spike_abs, tuple(interp_cols),
                     clean_temp_first, clean_no3_sentinel, step)
    d = flagged(with_position(aligned, spec), o)
    d = materialize(despiked(d, spec, o), staged)
    d = segmented(scanned(d, spec, o), o)
    d = materialize(d, checkpoint)      # cleaned, segmented series: stage boundary
    return materialize(featured(d, spec, o), checkpoint)   # the step feature table


def cycle_table(steps: DataFrame, name_col: str, reactors: list[str] = VALID_REACTORS) -> DataFrame:
    """On-rows of the step table plus the fixed reactor code."""
    return add_reactor_code(active_rows(steps), name_col, reactors)
