"""Joins (J1, J2, J4). Physical strategy is left to Catalyst/AQE: no size-unchecked
broadcast hints; AQE turns a side into a broadcast only after measuring it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_sources(quality: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join on (key, time); duplicate matches multiply rows, as in a
    plain left merge. Unparsed times must be removed first (plain ``=``)."""
    return quality.join(current, on=keys, how="left")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per ``keys`` by ``order`` as a grouped min: partial
    aggregation, so a hot key is combined map-side instead of sorted in one task."""
    return first_by(df, keys, order)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row with the smallest ``order`` per ``keys`` as a grouped aggregate. With a
    single order column every payload column is a ``min_by`` (scalar buffers, hash
    aggregation); several order columns fall back to a min over one struct."""
    payload = [c for c in df.columns if c not in keys]
    if len(order) == 1:
        o = F.col(order[0])
        return df.groupBy(*keys).agg(*[(F.min(o) if c == order[0] else F.min_by(c, o)).alias(c)
                                      for c in payload])
    ordered = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                       F.struct(*payload).alias("_row"))
    return df.groupBy(*keys).agg(F.min(ordered).alias("_m")).select(*keys, "_m._row.*")


def compare_sites(results: DataFrame, on: list[str], site_col: str, sites: list, value_cols: list[str], tag: str) -> DataFrame:
    """The sites' values side by side, from one grouped result; a metric missing at a
    site is null. ``<value>_<tag><site>`` for each site."""
    return results.groupBy(*on).agg(*[F.max(F.when(F.col(site_col) == s, F.col(c))).alias(f"{c}_{tag}{s}")
                                      for c in value_cols for s in sites])


def site_report(replayed: DataFrame, outcomes: DataFrame, site_col: str, sites: list, tag: str = "site") -> DataFrame:
    """J4 in full: every error, safety, stop and target row of a cross-site comparison, the sites side by
    side: ``section, metric, value_<tag><site> ...``. Pass flags are 1 or 0. A stage that a site
    lacks is null there.

    ``replayed``: back-test rows with the site; ``outcomes``: one row per cycle with the site."""
    from . import metrics as M
    by = [site_col]
    signal, truth, elapsed = "t_signal", "T_remaining", "elapsed_time"
    late = M.late_stage_metrics(replayed, signal, truth, elapsed, by)
    target = M.target_check(late.select(site_col, F.col("late_mae").alias("mae"), F.col("late_rmse").alias("rmse")), "late_stage")
    parts = [
        ("errors", M.error_metrics(replayed, signal, truth, by)),
        ("errors", M.underprediction_rate(replayed, signal, truth, group=by)),
        ("late", late),
        ("target", target.select(site_col, F.col("mae_pass").cast("double").alias("mae_pass"), F.col("rmse_pass").cast("double").alias("rmse_pass"))),
        ("stop", M.stop_kpis(outcomes, group=by)),
    ]
    rows = None
    for section, wide in parts:
        names = [c for c in wide.columns if c != site_col]
        flat = wide.select(site_col, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(site_col, names, "metric", "value")
        flat = flat.select(F.lit(section).alias("section"), "metric", site_col, "value")
        rows = flat if rows is None else rows.unionByName(flat)
    stages = M.stage_metrics(replayed, signal, truth, elapsed, by)
    names = ["mae", "rmse", "n"]
    flat = stages.select(site_col, "stage", *[F.col(c).cast("double").alias(c) for c in names]).unpivot([site_col, "stage"], names, "metric", "value")
    rows = rows.unionByName(flat.select(F.concat(F.lit("stage "), "stage").alias("section"), "metric", site_col, "value"))
    return compare_sites(rows, ["section", "metric"], site_col, sites, ["value"], tag)
