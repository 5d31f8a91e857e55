"""The driver's ``events`` table as the sensor stand-in.

Mapping (fixed): key = user_id; order = (ts, event_id); k = props.k
  nh4 = value, or the -999 sentinel when value > 150
  no3 = value / 10            (absolute spike rule fires when value > 200)
  ph  = k / 10, or -999 when k = 0
  temp = 5 + k / 4
  current_r = value, on-flag threshold 10
Stand-in predictors for the back-test (deterministic row formulas):
  start model: 20 + 0.5 * nh4_rolling_mean + 2 * ph + 4 * weekday
  step model:  3 * nh4_rolling_mean - elapsed_time

Each Spark frame here has a DuckDB twin in ``SQL_CHAIN`` written with plain
per-key windows, which is what the oracle check compares against."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import SeriesSpec
from .build import build_dataset

SPEC = SeriesSpec(keys=("user_id",), order=("ts", "event_id"), bucket_seconds=86_400)
ON_THRESHOLD = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_col() -> F.Column:
    return F.get_json_object("props", "$.k").cast("double")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = k_col()
    v = F.col("value")
    return e.select("user_id", "ts", "event_id",
                    F.when(v > 150, F.lit(-999.0)).otherwise(v).alias("nh4"),
                    (v / 10).alias("no3"),
                    F.when(k == 0, F.lit(-999.0)).otherwise(k / 10).alias("ph"),
                    (F.lit(5.0) + k / 4).alias("temp"),
                    v.alias("current_r"))


def steps(spark: SparkSession, sf_dir: str, staged: bool = False) -> DataFrame:
    return build_dataset(aligned(spark, sf_dir), SPEC, current_col="current_r", threshold=ON_THRESHOLD, staged=staged)


def start_pred_expr() -> F.Column:
    return F.lit(20.0) + F.lit(0.5) * F.col("nh4_rolling_mean") + F.lit(2.0) * F.col("ph") + F.lit(4.0) * F.col("weekday")


def step_pred_expr() -> F.Column:
    return F.lit(3.0) * F.col("nh4_rolling_mean") - F.col("elapsed_time")


START_PRED_SQL = "(20.0 + 0.5 * nh4_rolling_mean + 2.0 * ph + 4.0 * weekday)"
STEP_PRED_SQL = "(3.0 * nh4_rolling_mean - elapsed_time)"

_IP = ["nh4", "no3", "ph"]


def _interp_cols() -> str:
    parts = []
    for c in _IP:
        parts.append(f"max(CASE WHEN {c} IS NOT NULL THEN pos END) OVER wb AS {c}_pp, "
                     f"last_value({c} IGNORE NULLS) OVER wb AS {c}_pv, "
                     f"min(CASE WHEN {c} IS NOT NULL THEN pos END) OVER wf AS {c}_np, "
                     f"first_value({c} IGNORE NULLS) OVER wf AS {c}_nv")
    return ",\n  ".join(parts)


def _interp_select() -> str:
    parts = []
    for c in _IP:
        parts.append(f"CASE WHEN {c} IS NOT NULL THEN {c} "
                     f"WHEN {c}_pp IS NOT NULL AND {c}_np IS NOT NULL "
                     f"THEN ({c}_nv - {c}_pv) / CAST({c}_np - {c}_pp AS DOUBLE) * (pos - {c}_pp) + {c}_pv "
                     f"WHEN {c}_pp IS NOT NULL THEN {c}_pv ELSE {c}_nv END AS {c}")
    return ",\n  ".join(parts)


# Ordered CTE chain; ``with_chain(name)`` emits every CTE up to ``name``.
SQL_CHAIN: list[tuple[str, str]] = [
    ("ev", """SELECT user_id, ts, event_id, value, event_type, props,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"""),
    ("aligned", """SELECT user_id, ts, event_id,
  CASE WHEN value > 150 THEN -999.0 ELSE value END AS nh4,
  value / 10 AS no3,
  CASE WHEN k = 0 THEN -999.0 ELSE k / 10 END AS ph,
  5.0 + k / 4 AS temp,
  value AS current_r FROM ev"""),
    ("pos", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM aligned"""),
    ("sent", """SELECT * REPLACE (nullif(nh4, -999.0) AS nh4, nullif(ph, -999.0) AS ph) FROM pos"""),
    ("spk", """SELECT *, quantile_cont(no3, 0.5) OVER w5 AS med, coalesce(stddev_samp(no3) OVER w5, 1.0) AS sd
  FROM sent WINDOW w5 AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""),
    ("clean", """SELECT * EXCLUDE (med, sd) REPLACE (
  CASE WHEN abs(no3 - med) > 5.0 * sd OR no3 > 20.0 THEN NULL ELSE no3 END AS no3) FROM spk"""),
    ("ip", "SELECT *,\n  " + _interp_cols() + """
  FROM clean WINDOW wb AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  wf AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    ("interp", "SELECT user_id, ts, event_id, pos, temp, current_r,\n  " + _interp_select() + " FROM ip"),
    ("flg", """SELECT *, CAST(CASE WHEN current_r > 10.0 THEN 1 ELSE 0 END AS INTEGER) AS current_aeration FROM interp"""),
    ("chg", """SELECT *, CASE WHEN lag(current_aeration) OVER (PARTITION BY user_id ORDER BY pos)
  IS DISTINCT FROM current_aeration THEN 1 ELSE 0 END AS c FROM flg"""),
    ("runs", """SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM chg"""),
    ("cyc", """SELECT *,
  CAST(CASE WHEN current_aeration = 1 THEN count(*) OVER (PARTITION BY user_id, run_id) * 10 ELSE 0 END AS INTEGER) AS cycle_runtime,
  CAST((row_number() OVER (PARTITION BY user_id, run_id ORDER BY pos) - 1) * 10 * current_aeration AS INTEGER) AS elapsed_time,
  CAST(row_number() OVER (PARTITION BY user_id, run_id ORDER BY pos) - 1 AS BIGINT) AS run_pos,
  CAST(count(*) OVER (PARTITION BY user_id, run_id) AS BIGINT) AS run_rows
  FROM runs"""),
    ("steps", """SELECT *,
  CAST(cycle_runtime - elapsed_time AS INTEGER) AS T_remaining,
  coalesce(nh4 - lag(nh4) OVER wr, 0.0) AS nh4_diff,
  coalesce(no3 - lag(no3) OVER wr, 0.0) AS no3_diff,
  coalesce(ph - lag(ph) OVER wr, 0.0) AS ph_diff,
  coalesce(nh4 - lag(nh4, 3) OVER wr, 0.0) / 30.0 AS nh4_decay_rate,
  avg(nh4) OVER (PARTITION BY user_id, run_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS nh4_rolling_mean,
  CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  sin(2 * pi() * hour(ts) / 24.0) AS hour_sin,
  cos(2 * pi() * hour(ts) / 24.0) AS hour_cos,
  nh4 / (no3 + 1e-6) AS nh4_no3_ratio,
  468.0 / (31.6 + temp) AS do_saturation
  FROM cyc WINDOW wr AS (PARTITION BY user_id, run_id ORDER BY pos)"""),
    # back-test on on-rows
    ("onp", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS opos
  FROM steps WHERE current_aeration = 1"""),
    ("cno", """SELECT *, CAST(sum(CASE WHEN elapsed_time = 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY opos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle_no FROM onp"""),
    ("rst", """SELECT *, CASE WHEN lag(cycle_no) OVER wo IS DISTINCT FROM cycle_no
  OR elapsed_time < lag(elapsed_time) OVER wo THEN 1 ELSE 0 END AS rs
  FROM cno WINDOW wo AS (PARTITION BY user_id ORDER BY opos)"""),
    ("seg", """SELECT *, CAST(sum(rs) OVER (PARTITION BY user_id ORDER BY opos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_no FROM rst"""),
    ("buf", """SELECT *, CAST(least(7, row_number() OVER (PARTITION BY user_id, segment_no ORDER BY opos)) AS INTEGER) AS buffer_fill FROM seg"""),
    ("starts", f"""SELECT user_id, ts, event_id, cycle_runtime, {START_PRED_SQL} AS start_pred_raw
  FROM steps WHERE current_aeration = 1 AND elapsed_time = 0"""),
    ("sdd", """SELECT user_id, ts, arg_min(start_pred_raw, event_id) AS spr, arg_min(cycle_runtime, event_id) AS actual
  FROM starts GROUP BY user_id, ts"""),
    ("firsts", """SELECT b.user_id, b.cycle_no, CAST(trunc(greatest(10.0, s.spr)) AS INTEGER) AS start_pred, s.actual
  FROM buf b JOIN sdd s ON b.user_id = s.user_id AND b.ts = s.ts WHERE b.elapsed_time = 0"""),
    ("rep", f"""SELECT b.*, f.start_pred, f.actual AS actual_runtime, {STEP_PRED_SQL} AS step_pred
  FROM buf b JOIN firsts f ON b.user_id = f.user_id AND b.cycle_no = f.cycle_no"""),
    ("sig", """SELECT *, greatest(0, start_pred - elapsed_time) AS base_remaining,
  CASE WHEN elapsed_time < 60 OR buffer_fill < 7 THEN 'xgb_only' ELSE 'integrated' END AS mode FROM rep"""),
    ("sig2", """SELECT *, CASE WHEN mode = 'xgb_only' THEN CAST(base_remaining AS DOUBLE)
  ELSE greatest(CAST(base_remaining AS DOUBLE), greatest(0.0, step_pred)) END AS raw_signal FROM sig"""),
    ("replayed", """SELECT *, CAST(trunc(least(greatest(raw_signal, 10.0), 250.0)) AS INTEGER) AS t_signal,
  NOT (raw_signal >= 10.0 AND raw_signal <= 250.0) AS was_clamped,
  CAST(trunc(least(greatest(raw_signal, 10.0), 250.0)) AS INTEGER) > 20 AS should_continue FROM sig2"""),
    ("outc", """SELECT user_id, cycle_no, max(actual_runtime) AS actual_runtime,
  arg_min(elapsed_time, opos) FILTER (WHERE t_signal <= 20) AS stop_elapsed,
  arg_min(nh4, opos) FILTER (WHERE t_signal <= 20) AS stop_nh4
  FROM replayed GROUP BY user_id, cycle_no"""),
]
_NAMES = [n for n, _ in SQL_CHAIN]


def with_chain(upto: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding every chain CTE up to ``upto`` plus ``extra`` CTEs."""
    idx = _NAMES.index(upto)
    ctes = SQL_CHAIN[: idx + 1] + list(extra or [])
    return "WITH " + ",\n".join(f"{n} AS (\n{body}\n)" for n, body in ctes) + "\n"

# start-model features available on the stand-in (no reactor code on events)
from ..schema import XGB_FEATURES as _XF  # noqa: E402

START_FEATURES = [f for f in _XF if f != "reactor"]
