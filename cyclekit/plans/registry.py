"""Query registry: one Spark plan per operator of the inventory, each with the
DuckDB twin used by the correctness check (plain per-key windows over the
same parquet tables). All doubles are rounded to 6 digits on both sides."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clean, control, cycles, features, joins, metrics
from ..operators.series import POS, materialize, with_position
from ..schema import (CURRENT_REACTORS, INPUT_BOUNDS, LSTM_FEATURES, QUALITY_REACTORS,
                      REACTOR_NAME_MAP, SEPT_IMPUTE, VALID_REACTORS)
from . import standin as SI
from .standin import SPEC, table, with_chain

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(c)


def R6(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) AS {c}"


# ---------------------------------------------------------------- shared frames
RAW_CHAIN = [
    ("rp", """SELECT user_id, ts, event_id, value, event_type,
  CAST(CASE WHEN value > 10.0 THEN 1 ELSE 0 END AS INTEGER) AS f,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"""),
    ("rc", """SELECT *, CASE WHEN lag(f) OVER (PARTITION BY user_id ORDER BY pos) IS DISTINCT FROM f
  THEN 1 ELSE 0 END AS c FROM rp"""),
    ("rr", """SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM rc"""),
    ("ry", """SELECT *,
  CAST(CASE WHEN f = 1 THEN count(*) OVER (PARTITION BY user_id, run_id) * 10 ELSE 0 END AS INTEGER) AS cycle_runtime,
  CAST((row_number() OVER (PARTITION BY user_id, run_id ORDER BY pos) - 1) * 10 * f AS INTEGER) AS elapsed_time
  FROM rr"""),
    ("raw", "SELECT *, CAST(cycle_runtime - elapsed_time AS INTEGER) AS T_remaining FROM ry"),
]


def raw_with(*extra: tuple[str, str]) -> str:
    ctes = RAW_CHAIN + list(extra)
    return "WITH " + ",\n".join(f"{n} AS (\n{b}\n)" for n, b in ctes) + "\n"


def raw_segmented(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value", "event_type")
    return cycles.cycle_columns(cycles.add_flag(e, "value", 10.0, out="f"), SPEC, flag="f")


def steps(spark: SparkSession, sf: str, staged: bool = False) -> DataFrame:
    return SI.steps(spark, sf, staged)


def starts_of(st: DataFrame) -> DataFrame:
    return (st.filter((F.col("current_aeration") == 1) & (F.col("elapsed_time") == 0))
              .withColumn("start_pred_raw", SI.start_pred_expr()))


def replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The back-test. Its carry reads the step table twice, so that is staged: building it a
    second time would cost another pass over the source and all its shuffles."""
    st = materialize(steps(spark, sf))
    return control.replay(st, None, SPEC, SI.start_pred_expr(), SI.step_pred_expr())


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return control.cycle_outcomes(replayed(spark, sf), ["user_id"], "cycle_no")


# names derived from event types (stand-ins for instrument / motor names)
NAME_SQL = ("CASE event_type WHEN 'view' THEN '반응조 A' WHEN 'click' THEN '반응조 B' "
            "WHEN 'purchase' THEN '반응조 C' ELSE NULL END")
MOTOR_SQL = ("CASE event_type WHEN 'view' THEN 'MOP-202A 포기기' WHEN 'click' THEN 'MOP-202B 포기기' "
             "ELSE 'MOP-203 포기기' END")


def name_col() -> F.Column:
    t = F.col("event_type")
    return (F.when(t == "view", "반응조 A").when(t == "click", "반응조 B")
             .when(t == "purchase", "반응조 C"))


def motor_col() -> F.Column:
    t = F.col("event_type")
    return (F.when(t == "view", "MOP-202A 포기기").when(t == "click", "MOP-202B 포기기")
             .otherwise("MOP-203 포기기"))


# ================================================================ W1-W4, A1, P8
@register("cycle_summary", raw_with() + """SELECT user_id, run_id, min(ts) AS start_ts, max(ts) AS end_ts,
  CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) * 10 AS BIGINT) AS runtime_min
  FROM raw WHERE f = 1 GROUP BY user_id, run_id""")
def q_cycle_summary(spark, sf):
    return cycles.cycle_summary(raw_segmented(spark, sf), ["user_id"], "ts", "run_id", flag="f")


@register("threshold_flag", """SELECT event_id, CAST(CASE WHEN value > 10.0 THEN 1 ELSE 0 END AS INTEGER)
  AS current_aeration FROM events""")
def q_threshold_flag(spark, sf):
    e = table(spark, sf, "events")
    return cycles.add_flag(e, "value", 10.0).select("event_id", "current_aeration")


@register("run_id", raw_with() + "SELECT user_id, event_id, run_id FROM raw")
def q_run_id(spark, sf):
    return raw_segmented(spark, sf).select("user_id", "event_id", "run_id")


@register("cycle_runtime", raw_with() + "SELECT user_id, event_id, cycle_runtime FROM raw")
def q_cycle_runtime(spark, sf):
    return raw_segmented(spark, sf).select("user_id", "event_id", "cycle_runtime")


@register("elapsed_time", raw_with() + "SELECT user_id, event_id, elapsed_time FROM raw")
def q_elapsed_time(spark, sf):
    return raw_segmented(spark, sf).select("user_id", "event_id", "elapsed_time")


@register("t_remaining", raw_with() + "SELECT user_id, event_id, T_remaining FROM raw")
def q_t_remaining(spark, sf):
    return raw_segmented(spark, sf).select("user_id", "event_id", "T_remaining")


@register("active_rows", raw_with() + """SELECT user_id, event_id, cycle_runtime, elapsed_time FROM raw
  WHERE NOT (cycle_runtime = 0 AND f = 1) AND f = 1""")
def q_active_rows(spark, sf):
    d = cycles.active_rows(raw_segmented(spark, sf), flag="f")
    return d.select("user_id", "event_id", "cycle_runtime", "elapsed_time")


@register("start_counter_id", raw_with(("act", "SELECT * FROM raw WHERE f = 1")) + """SELECT user_id, event_id,
  CAST(sum(CASE WHEN elapsed_time = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cycle_no FROM act""")
def q_start_counter_id(spark, sf):
    d = raw_segmented(spark, sf).filter(F.col("f") == 1)
    return cycles.start_counter_id(d, SPEC).select("user_id", "event_id", "cycle_no")


@register("cycle_first_row", with_chain("cno") + """SELECT user_id, cycle_no, arg_min(event_id, opos) AS event_id,
  arg_min(ts, opos) AS ts, round(arg_min(nh4, opos), 6) AS nh4 FROM cno GROUP BY user_id, cycle_no""")
def q_cycle_first_row(spark, sf):
    d = _cno(spark, sf).filter(F.col("current_aeration") == 1)
    first = cycles.cycle_first_row(d.select("user_id", "cycle_no", POS, "event_id", "ts", "nh4"),
                                   ["user_id"], "cycle_no", [POS])
    return first.select("user_id", "cycle_no", "event_id", "ts", r6("nh4"))


def _cno(spark, sf):
    """Step table with the cycle number of every on-row (null on off-rows), keeping
    the series positions so later windows can use the block layout directly."""
    st = steps(spark, sf)
    on = F.col("current_aeration") == 1
    d = cycles.start_counter_id(st.withColumn("_e0", F.when(on, F.col("elapsed_time"))), SPEC, "_e0", "cycle_no")
    return d.withColumn("cycle_no", F.when(on, F.col("cycle_no"))).drop("_e0")


def run_cycles(spark, sf):
    """As ``_cno``, from the build's own run numbers instead of another carry."""
    return cycles.run_cycle_no(steps(spark, sf))


# ================================================================ build pieces
STEP_COLS = ["user_id", "event_id", "nh4", "no3", "ph", "temp", "current_r", "current_aeration", "run_id",
             "cycle_runtime", "elapsed_time", "T_remaining", "nh4_diff", "no3_diff", "ph_diff",
             "nh4_decay_rate", "nh4_rolling_mean", "hour", "weekday", "hour_sin", "hour_cos",
             "nh4_no3_ratio", "do_saturation"]
STEP_DOUBLES = {"nh4", "no3", "ph", "temp", "current_r", "nh4_diff", "no3_diff", "ph_diff", "nh4_decay_rate",
                "nh4_rolling_mean", "hour_sin", "hour_cos", "nh4_no3_ratio", "do_saturation"}


def _step_select(cols):
    return [r6(c) if c in STEP_DOUBLES else F.col(c) for c in cols]


def _step_sql(cols):
    return ", ".join(R6(c) if c in STEP_DOUBLES else c for c in cols)


@register("build_dataset", with_chain("steps") + f"SELECT ts, {_step_sql(STEP_COLS)} FROM steps")
def q_build_dataset(spark, sf):
    return steps(spark, sf).select("ts", *_step_select(STEP_COLS))


def _simple_step(name, cols):
    @register(name, with_chain("steps") + f"SELECT {_step_sql(['user_id', 'event_id'] + cols)} FROM steps")
    def q(spark, sf):
        return steps(spark, sf).select(*_step_select(["user_id", "event_id"] + cols))
    return q


_simple_step("run_diff", ["nh4_diff", "no3_diff", "ph_diff"])
_simple_step("decay_rate", ["nh4_decay_rate"])
_simple_step("rolling_mean", ["nh4_rolling_mean"])
_simple_step("guarded_ratio", ["nh4_no3_ratio"])


def _simple_row(name, cols):
    """Row formulas straight from the source columns: no series positions are needed."""
    @register(name, with_chain("steps") + f"SELECT {_step_sql(['user_id', 'event_id'] + cols)} FROM steps")
    def q(spark, sf):
        d = features.ratio_features(features.calendar_features(SI.aligned(spark, sf), "ts"))
        return d.select(*_step_select(["user_id", "event_id"] + cols))
    return q


_simple_row("do_saturation", ["do_saturation"])
_simple_row("cyclic_hour", ["hour", "hour_sin", "hour_cos"])
_simple_step("interpolate_linear", ["nh4", "no3", "ph"])


@register("null_sentinel", with_chain("sent") + f"SELECT event_id, {R6('nh4')}, {R6('ph')} FROM sent")
def q_null_sentinel(spark, sf):
    d = clean.null_sentinel(SI.aligned(spark, sf), ["nh4", "ph"])
    return d.select("event_id", r6("nh4"), r6("ph"))


@register("centered_median_std", with_chain("spk") + f"SELECT user_id, event_id, {R6('med')}, {R6('sd')} FROM spk")
def q_centered(spark, sf):
    d = clean.null_sentinel(with_position(SI.aligned(spark, sf), SPEC), ["nh4", "ph"])
    d = clean.centered_stats(d, SPEC, "no3", 5, med="med", std="sd")
    return d.select("user_id", "event_id", r6("med"), r6("sd"))


@register("despike", with_chain("clean") + f"SELECT user_id, event_id, {R6('no3')} FROM clean")
def q_despike(spark, sf):
    d = clean.null_sentinel(with_position(SI.aligned(spark, sf), SPEC), ["nh4", "ph"])
    d = clean.despike(d, SPEC, "no3")
    return d.select("user_id", "event_id", r6("no3"))


@register("calendar_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day FROM events""")
def q_calendar(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.hour_of("ts").alias("hour"), S.weekday_of("ts").alias("weekday"),
                    S.month_of("ts").alias("month"), S.day_of("ts").alias("day"))


@register("impute_ramp", """SELECT event_id,
  round(CASE WHEN month(t) = 1 THEN 23.87 + (21.33 - 23.87) * (day(t) - 1) / 29.0 ELSE temp END, 6) AS temp,
  round(CASE WHEN month(t) = 1 THEN 8.437 + (8.843 - 8.437) * (day(t) - 1) / 29.0 ELSE 468.0 / (31.6 + temp) END, 6)
  AS do_saturation FROM (SELECT event_id, ts + to_months(CAST(event_id % 2 AS INTEGER)) AS t,
  5.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4 AS temp FROM events)""")
def q_impute_ramp(spark, sf):
    # the events cover one month: odd ids move a month on, so that both branches run
    d = SI.aligned(spark, sf).withColumn("ts", F.expr("ts + make_ym_interval(0, cast(event_id % 2 AS int))"))
    d = clean.impute_ramp(features.ratio_features(d), "ts", SEPT_IMPUTE, month=1, span_days=29)
    return d.select("event_id", r6("temp"), r6("do_saturation"))


# ================================================================ P-rows on names / times
@register("project_prune", "SELECT user_id, ts, value FROM events")
def q_project(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", "value")


@register("filter_members", f"""SELECT event_id, name FROM (SELECT event_id, {NAME_SQL} AS name FROM events)
  WHERE name IN ('반응조 A', '반응조 B')""")
def q_filter_members(spark, sf):
    e = table(spark, sf, "events").select("event_id", name_col().alias("name"))
    return e.filter(F.col("name").isin(*QUALITY_REACTORS))


@register("normalize_key", f"""SELECT event_id, replace({NAME_SQL}, ' ', '') AS reactor FROM events""")
def q_normalize_key(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.strip_blanks(name_col()).alias("reactor"))


@register("map_key", f"""SELECT event_id, CASE {MOTOR_SQL} WHEN 'MOP-202A 포기기' THEN '반응조A'
  WHEN 'MOP-202B 포기기' THEN '반응조B' ELSE NULL END AS reactor FROM events""")
def q_map_key(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", S.map_values(motor_col(), REACTOR_NAME_MAP).alias("reactor"))


@register("encode_category", f"""SELECT event_id, CAST(CASE replace({NAME_SQL}, ' ', '') WHEN '반응조A' THEN 0
  WHEN '반응조B' THEN 1 ELSE NULL END AS INTEGER) AS reactor FROM events""")
def q_encode(spark, sf):
    e = table(spark, sf, "events").withColumn("nm", S.strip_blanks(name_col()))
    return features.add_reactor_code(e, "nm", VALID_REACTORS).select("event_id", "reactor")


TS_TEXT_SQL = ("CASE WHEN event_type IN ('view', 'click') THEN strftime(ts, '%-m월%-d월%y %-H:%M') "
               "WHEN event_type IN ('signup', 'purchase') THEN strftime(ts, '%Y-%m-%d %H:%M:%S') "
               "ELSE 'n/a' END")


def ts_text() -> F.Column:
    t = F.col("event_type")
    return (F.when(t.isin("view", "click"), F.date_format("ts", "M'월'd'월'yy H:mm"))
             .when(t.isin("signup", "purchase"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
             .otherwise(F.lit("n/a")))


PARSE_SQL = """coalesce(try_strptime(txt, '%m월%d월%y %H:%M'), TRY_CAST(txt AS TIMESTAMP))"""


@register("parse_ts", f"""SELECT event_id, txt, {PARSE_SQL} AS parsed
  FROM (SELECT event_id, {TS_TEXT_SQL} AS txt FROM events)""")
def q_parse_ts(spark, sf):
    e = table(spark, sf, "events").select("event_id", ts_text().alias("txt"))
    return e.select("event_id", "txt", S.parse_ts("txt").alias("parsed"))


@register("bad_ts_count", f"""SELECT CAST(count(*) FILTER (WHERE {PARSE_SQL} IS NULL) AS BIGINT) AS bad_ts
  FROM (SELECT {TS_TEXT_SQL} AS txt FROM events)""")
def q_bad_ts(spark, sf):
    e = table(spark, sf, "events").select(S.parse_ts(ts_text()).alias("parsed"))
    return clean.bad_ts_count(e, "parsed")


# ================================================================ validation / contract
def _rules_sql() -> str:
    parts = []
    for c, (lo, hi) in INPUT_BOUNDS.items():
        col = "current_r" if c == "current_r" else c
        cond = [f"{col} IS NULL"]
        if lo is not None:
            cond.append(f"{col} < {lo}")
        if hi is not None:
            cond.append(f"{col} > {hi}")
        parts.append(f"CASE WHEN {' OR '.join(cond)} THEN '{c}_range' END")
    parts.append("CASE WHEN elapsed_time IS NULL OR elapsed_time % 10 <> 0 THEN 'elapsed_time_step' END")
    parts.append("CASE WHEN reactor IS NULL OR reactor NOT IN ('반응조A', '반응조B') THEN 'reactor_allowed' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


@register("validate_rows", with_chain("steps") + f"""SELECT event_id, array_to_string(v, ',') AS violations,
  len(v) = 0 AS is_valid FROM (SELECT event_id, {_rules_sql()} AS v
  FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN '반응조A' WHEN 1 THEN '반응조B' ELSE '반응조C' END AS reactor FROM steps))""")
def q_validate(spark, sf):
    d = steps(spark, sf).withColumn(
        "reactor", F.when(F.col("user_id") % 3 == 0, "반응조A").when(F.col("user_id") % 3 == 1, "반응조B")
        .otherwise("반응조C"))
    v = clean.validate_rows(d, clean.range_rules())
    return v.select("event_id", F.array_join("violations", ",").alias("violations"), "is_valid")


@register("rename_contract", with_chain("steps") + """SELECT event_id, round(current_r, 6) AS "상전류(R)",
  CAST(weekday AS DOUBLE) AS weekday, CAST(elapsed_time AS BIGINT) AS elapsed_time FROM steps""")
def q_rename(spark, sf):
    d = steps(spark, sf).withColumnsRenamed({"current_r": "상전류(R)"})
    return d.select("event_id", F.round("상전류(R)", 6).alias("상전류(R)"),
                    F.col("weekday").cast("double").alias("weekday"),
                    F.col("elapsed_time").cast("long").alias("elapsed_time"))


# ================================================================ joins / sets
@register("align_left_join", """WITH q AS (SELECT user_id, date_trunc('hour', ts) AS hour_ts, event_id AS q_event_id,
  value AS nh4 FROM events WHERE event_type IN ('view', 'click', 'purchase')),
c AS (SELECT user_id, date_trunc('hour', ts) AS hour_ts, value AS current_r FROM events
  WHERE event_type IN ('signup', 'error'))
SELECT q.user_id, q.hour_ts, q.q_event_id, q.nh4, c.current_r FROM q LEFT JOIN c
  ON q.user_id = c.user_id AND q.hour_ts = c.hour_ts""")
def q_align(spark, sf):
    e = table(spark, sf, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_ts")
    q = e.filter(F.col("event_type").isin("view", "click", "purchase")).select(
        "user_id", hour, F.col("event_id").alias("q_event_id"), F.col("value").alias("nh4"))
    c = e.filter(F.col("event_type").isin("signup", "error")).select(
        "user_id", hour, F.col("value").alias("current_r"))
    return joins.align_sources(q, c, ["user_id", "hour_ts"])


@register("union_months", """SELECT user_id, ts, value AS nh4, NULL::DOUBLE AS no3 FROM events
  WHERE event_type IN ('view', 'click')
  UNION ALL SELECT user_id, ts, NULL::DOUBLE AS nh4, value AS no3 FROM events
  WHERE event_type NOT IN ('view', 'click')""")
def q_union(spark, sf):
    e = table(spark, sf, "events")
    a = e.filter(F.col("event_type").isin("view", "click")).select("user_id", "ts", F.col("value").alias("nh4"))
    b = e.filter(~F.col("event_type").isin("view", "click")).select("user_id", "ts", F.col("value").alias("no3"))
    return a.unionByName(b, allowMissingColumns=True).select("user_id", "ts", "nh4", "no3")


@register("read_months", """SELECT event_id, user_id, ts, value, CAST(1 AS INTEGER) AS month,
  'events.parquet' AS source_file FROM events""")
def q_read_months(spark, sf):
    from ..sources.readers import read_months
    d = read_months(spark, {1: f"{sf}/events.parquet"})
    return d.select("event_id", "user_id", "ts", "value", "month", "source_file")


# ================================================================ back-test and KPIs
REPLAY_COLS = ["user_id", "event_id", "cycle_no", "elapsed_time", "T_remaining", "start_pred", "step_pred",
               "buffer_fill", "segment_no", "base_remaining", "mode", "raw_signal", "t_signal",
               "was_clamped", "should_continue"]
REPLAY_DOUBLES = {"step_pred", "raw_signal"}


def _rep_select(cols):
    return [r6(c) if c in REPLAY_DOUBLES else F.col(c) for c in cols]


def _rep_sql(cols):
    return ", ".join(R6(c) if c in REPLAY_DOUBLES else c for c in cols)


@register("replay_cycles", with_chain("replayed") + f"SELECT {_rep_sql(REPLAY_COLS)} FROM replayed")
def q_replay(spark, sf):
    return replayed(spark, sf).select(*_rep_select(REPLAY_COLS))


def _simple_rep(name, cols):
    @register(name, with_chain("replayed") + f"SELECT {_rep_sql(['user_id', 'event_id'] + cols)} FROM replayed")
    def q(spark, sf):
        return replayed(spark, sf).select(*_rep_select(["user_id", "event_id"] + cols))
    return q


_simple_rep("base_remaining", ["start_pred", "elapsed_time", "base_remaining"])
_simple_rep("choose_mode", ["elapsed_time", "buffer_fill", "mode"])
_simple_rep("control_signal", ["mode", "raw_signal", "t_signal"])
_simple_rep("stop_flag", ["t_signal", "should_continue"])
_simple_rep("clamp_signal", ["raw_signal", "t_signal", "was_clamped"])
_simple_rep("reset_segment", ["cycle_no", "segment_no"])
_simple_rep("buffer_fill", ["cycle_no", "buffer_fill"])


@register("clip_nonneg", with_chain("replayed") + """SELECT event_id, round(greatest(0.0, step_pred), 6) AS step_pred_nonneg
  FROM replayed""")
def q_clip(spark, sf):
    return replayed(spark, sf).select("event_id", F.round(S.clip_nonneg("step_pred"), 6).alias("step_pred_nonneg"))


@register("start_floor", with_chain("steps") + f"""SELECT event_id, CAST(trunc(greatest(10.0, {SI.START_PRED_SQL}))
  AS INTEGER) AS start_pred FROM steps WHERE current_aeration = 1 AND elapsed_time = 0""")
def q_start_floor(spark, sf):
    return starts_of(steps(spark, sf)).select("event_id", S.start_floor("start_pred_raw").alias("start_pred"))


@register("match_cycle_start", with_chain("starts", [("starts2", """SELECT * FROM starts WHERE event_id % 5 <> 0
  UNION ALL SELECT user_id, ts, event_id + 1000000000, cycle_runtime, start_pred_raw + 7 FROM starts WHERE event_id % 5 BETWEEN 1 AND 2"""),
    ("sdd2", """SELECT user_id, ts, arg_min(start_pred_raw, event_id) AS spr, arg_min(cycle_runtime, event_id) AS actual
  FROM starts2 GROUP BY user_id, ts""")]) + """SELECT b.user_id, b.cycle_no,
  CAST(trunc(greatest(10.0, s.spr)) AS INTEGER) AS start_pred, s.actual
  FROM buf b JOIN sdd2 s ON b.user_id = s.user_id AND b.ts = s.ts WHERE b.elapsed_time = 0""")
def q_match(spark, sf):
    """Start records given as a table that lacks some starts and repeats others."""
    st = materialize(steps(spark, sf))
    own = starts_of(st).select("user_id", "ts", "event_id", "cycle_runtime", "start_pred_raw")
    again = own.filter("event_id % 5 BETWEEN 1 AND 2").withColumns({"event_id": F.col("event_id") + 1_000_000_000,
                                                        "start_pred_raw": F.col("start_pred_raw") + 7})
    given = own.filter("event_id % 5 <> 0").unionByName(again)
    d = control.replay(st, given, SPEC, "start_pred_raw", SI.step_pred_expr())
    return (d.filter(F.col("elapsed_time") == 0)
             .select("user_id", "cycle_no", "start_pred", F.col("actual_runtime").alias("actual")))


@register("first_stop", with_chain("outc") + f"SELECT user_id, cycle_no, stop_elapsed, {R6('stop_nh4')} FROM outc")
def q_first_stop(spark, sf):
    d = control.first_stop(replayed(spark, sf), ["user_id"], "cycle_no")
    return d.select("user_id", "cycle_no", "stop_elapsed", r6("stop_nh4"))


@register("current_history", with_chain("replayed") + """SELECT user_id, cycle_no, elapsed_time, t_signal,
  elapsed_time + t_signal AS predicted_end_time, start_pred AS xgb_prediction, mode, was_clamped FROM replayed
  WHERE cycle_no = (SELECT max(cycle_no) FROM replayed r2 WHERE r2.user_id = replayed.user_id)""")
def q_history(spark, sf):
    d = control.current_history(materialize(replayed(spark, sf)), SPEC, "cycle_no")      # read for the rows and the latest cycle
    return d.select("user_id", "cycle_no", "elapsed_time", "t_signal", "predicted_end_time",
                    F.col("start_pred").alias("xgb_prediction"), "mode", "was_clamped")


def _metric_sql(body: str) -> str:
    return with_chain("replayed") + body


@register("error_metrics", _metric_sql("""SELECT round(avg(abs(t_signal - T_remaining)), 6) AS mae,
  round(sqrt(avg((t_signal - T_remaining) * (t_signal - T_remaining))), 6) AS rmse,
  CAST(count(*) AS BIGINT) AS n FROM replayed"""))
def q_error(spark, sf):
    return metrics.error_metrics(replayed(spark, sf), "t_signal", "T_remaining").select(r6("mae"), r6("rmse"), "n")


@register("underprediction_rate", _metric_sql("""SELECT round(avg(CASE WHEN t_signal < T_remaining - 20
  THEN 1.0 ELSE 0.0 END), 6) AS underprediction_rate FROM replayed"""))
def q_under(spark, sf):
    return metrics.underprediction_rate(replayed(spark, sf), "t_signal", "T_remaining").select(
        r6("underprediction_rate"))


STAGE_SQL = ("CASE WHEN elapsed_time BETWEEN 0 AND 30 THEN '0~30' WHEN elapsed_time BETWEEN 31 AND 90 "
             "THEN '31~90' WHEN elapsed_time BETWEEN 91 AND 9999 THEN '91+' END")


@register("stage_metrics", _metric_sql(f"""SELECT stage, round(avg(abs(d)), 6) AS mae,
  round(sqrt(avg(d * d)), 6) AS rmse, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT {STAGE_SQL} AS stage, CAST(t_signal - T_remaining AS DOUBLE) AS d FROM replayed)
  WHERE stage IS NOT NULL GROUP BY stage"""))
def q_stage(spark, sf):
    return metrics.stage_metrics(replayed(spark, sf), "t_signal", "T_remaining", "elapsed_time").select(
        "stage", r6("mae"), r6("rmse"), "n")


LATE_SQL = """round(avg(abs(d)) FILTER (WHERE elapsed_time >= 91), 6) AS late_mae,
  round(sqrt(avg(d * d) FILTER (WHERE elapsed_time >= 91)), 6) AS late_rmse,
  CAST(count(*) FILTER (WHERE elapsed_time >= 91) AS BIGINT) AS late_n,
  round(avg(abs(d)) FILTER (WHERE elapsed_time >= 60), 6) AS integrated_mae,
  round(sqrt(avg(d * d) FILTER (WHERE elapsed_time >= 60)), 6) AS integrated_rmse,
  CAST(count(*) FILTER (WHERE elapsed_time >= 60) AS BIGINT) AS integrated_n"""
LATE_COLS = ["late_mae", "late_rmse", "late_n", "integrated_mae", "integrated_rmse", "integrated_n"]


@register("late_stage_metrics", _metric_sql(f"""SELECT {LATE_SQL}
  FROM (SELECT elapsed_time, CAST(t_signal - T_remaining AS DOUBLE) AS d FROM replayed)"""))
def q_late(spark, sf):
    d = metrics.late_stage_metrics(replayed(spark, sf), "t_signal", "T_remaining", "elapsed_time")
    return d.select(*[r6(c) if not c.endswith("_n") else F.col(c) for c in LATE_COLS])


@register("target_check", _metric_sql("""SELECT round(late_mae, 6) AS mae, round(late_rmse, 6) AS rmse,
  coalesce(late_mae < 30.0, false) AS mae_pass, coalesce(late_rmse < 45.0, false) AS rmse_pass
  FROM (SELECT avg(abs(d)) FILTER (WHERE elapsed_time >= 91) AS late_mae,
  sqrt(avg(d * d) FILTER (WHERE elapsed_time >= 91)) AS late_rmse
  FROM (SELECT elapsed_time, CAST(t_signal - T_remaining AS DOUBLE) AS d FROM replayed))"""))
def q_target(spark, sf):
    d = metrics.late_stage_metrics(replayed(spark, sf), "t_signal", "T_remaining", "elapsed_time")
    d = d.select(F.col("late_mae").alias("mae"), F.col("late_rmse").alias("rmse"))
    return metrics.target_check(d, "late_stage").select(r6("mae"), r6("rmse"), "mae_pass", "rmse_pass")


@register("mode_counts", _metric_sql("""SELECT CASE WHEN elapsed_time < 60 THEN 'xgb_only' ELSE 'integrated' END
  AS phase, CAST(count(*) AS BIGINT) AS n_steps, CAST(sum(CAST(was_clamped AS BIGINT)) AS BIGINT) AS n_clamped
  FROM replayed GROUP BY 1"""))
def q_mode_counts(spark, sf):
    return metrics.mode_counts(replayed(spark, sf))


KPI_SQL = """CAST(count(*) AS BIGINT) AS n_cycles, CAST(count(stop_elapsed) AS BIGINT) AS n_stopped,
  round(avg(CASE WHEN stop_elapsed IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_stop_rate,
  round(coalesce(avg(actual_runtime - stop_elapsed), 0.0), 6) AS avg_time_saved,
  round(coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN actual_runtime - stop_elapsed > 20
    THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS unsafe_early_stop_rate,
  round(coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN greatest(0.0, -(actual_runtime - stop_elapsed))
    END), 0.0), 6) AS avg_overrun,
  round(coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN stop_nh4 > 5.0 THEN 1.0 ELSE 0.0 END
    END), 0.0), 6) AS nh4_risk_rate"""
KPI_COLS = ["n_cycles", "n_stopped", "no_stop_rate", "avg_time_saved", "unsafe_early_stop_rate",
            "avg_overrun", "nh4_risk_rate"]


@register("stop_kpis", with_chain("outc") + f"SELECT {KPI_SQL} FROM outc")
def q_kpis(spark, sf):
    d = metrics.stop_kpis(outcomes(spark, sf))
    return d.select(*[F.col(c) if c.startswith("n_") else r6(c) for c in KPI_COLS])


@register("energy_savings", with_chain("outc") + """SELECT CAST(count(*) AS BIGINT) AS test_cycles,
  round(avg(CAST(actual_runtime AS DOUBLE)), 6) AS actual_avg_min,
  round(avg(CAST(coalesce(stop_elapsed, actual_runtime) AS DOUBLE)), 6) AS sim_stop_avg_min,
  round(sum(CAST(actual_runtime - coalesce(stop_elapsed, actual_runtime) AS DOUBLE)), 6) AS saved_min,
  round(sum(CAST(actual_runtime - coalesce(stop_elapsed, actual_runtime) AS DOUBLE)) * (365.0 / 31)
    * (958862 * 0.55 / 365 / 1440), 3) AS saved_kwh_annual,
  round(sum(CAST(actual_runtime - coalesce(stop_elapsed, actual_runtime) AS DOUBLE)) * (365.0 / 31)
    * (958862 * 0.55 / 365 / 1440) * 110, 2) AS saved_krw_annual FROM outc""")
def q_energy(spark, sf):
    d = metrics.energy_savings(outcomes(spark, sf))
    return d.select("test_cycles", r6("actual_avg_min"), r6("sim_stop_avg_min"), r6("saved_min"),
                    F.round("saved_kwh_annual", 3).alias("saved_kwh_annual"),
                    F.round("saved_krw_annual", 2).alias("saved_krw_annual"))


@register("compare_sites", _metric_sql(f"""SELECT coalesce(a.stage, b.stage) AS stage, a.mae AS mae_site0,
  b.mae AS mae_site1, a.n AS n_site0, b.n AS n_site1 FROM
  (SELECT stage, round(avg(abs(d)), 6) AS mae, CAST(count(*) AS BIGINT) AS n FROM (SELECT {STAGE_SQL} AS stage,
   CAST(t_signal - T_remaining AS DOUBLE) AS d FROM replayed WHERE user_id % 2 = 0) WHERE stage IS NOT NULL
   GROUP BY stage) a
  FULL OUTER JOIN
  (SELECT stage, round(avg(abs(d)), 6) AS mae, CAST(count(*) AS BIGINT) AS n FROM (SELECT {STAGE_SQL} AS stage,
   CAST(t_signal - T_remaining AS DOUBLE) AS d FROM replayed WHERE user_id % 2 = 1) WHERE stage IS NOT NULL
   GROUP BY stage) b ON a.stage = b.stage"""))
def q_compare(spark, sf):
    d = replayed(spark, sf).withColumn("site", F.col("user_id") % 2)
    st = metrics.stage_metrics(d, "t_signal", "T_remaining", "elapsed_time", ["site"])
    j = joins.compare_sites(st.withColumn("mae", F.round("mae", 6)), ["stage"], "site", [0, 1], ["mae", "n"], "site")
    return j.select("stage", "mae_site0", "mae_site1", "n_site0", "n_site1")


@register("longest_cycle", _metric_sql("""SELECT user_id, cycle_no, n, start_ts, start_pred FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, start_ts ASC) AS r FROM (
  SELECT user_id, cycle_no, CAST(count(*) AS BIGINT) AS n, min(ts) AS start_ts, max(start_pred) AS start_pred
  FROM replayed GROUP BY user_id, cycle_no) WHERE start_pred >= 60) WHERE r = 1"""))
def q_longest(spark, sf):
    per = (replayed(spark, sf).groupBy("user_id", "cycle_no")
           .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start_ts"), F.max("start_pred").alias("start_pred")))
    return cycles.longest_cycle(per, ["user_id"], "n", "start_ts", "start_pred", 60).select(
        "user_id", "cycle_no", "n", "start_ts", "start_pred")


# ================================================================ other aggregates
@register("describe_target", with_chain("steps") + """SELECT CAST(count(x) AS BIGINT) AS count, round(avg(x), 6) AS mean,
  round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS p25,
  round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(max(x), 6) AS max
  FROM (SELECT CAST(cycle_runtime AS DOUBLE) AS x FROM steps WHERE current_aeration = 1 AND elapsed_time = 0)""")
def q_describe(spark, sf):
    d = metrics.describe(starts_of(steps(spark, sf)), "cycle_runtime")
    return d.select("count", *[r6(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("split_by_time", with_chain("steps") + """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00'
  THEN 'train' WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 'test' END AS split FROM steps
  WHERE current_aeration = 1 AND elapsed_time = 0""")
def q_split(spark, sf):
    d = cycles.split_label(starts_of(steps(spark, sf)), "ts", "2024-01-16 00:00:00")
    return d.select("event_id", "split")


@register("cycle_starts", with_chain("steps") + """SELECT user_id, event_id, ts, cycle_runtime FROM steps
  WHERE elapsed_time = 0 AND current_aeration = 1 AND nh4 IS NOT NULL AND no3 IS NOT NULL AND ph IS NOT NULL
  AND temp IS NOT NULL AND current_r IS NOT NULL AND nh4_no3_ratio IS NOT NULL AND do_saturation IS NOT NULL
  AND nh4_diff IS NOT NULL AND no3_diff IS NOT NULL AND ph_diff IS NOT NULL AND nh4_rolling_mean IS NOT NULL
  AND nh4_decay_rate IS NOT NULL AND hour_sin IS NOT NULL AND hour_cos IS NOT NULL AND weekday IS NOT NULL
  AND cycle_runtime IS NOT NULL""")
def q_cycle_starts(spark, sf):
    feats = [("current_r" if f == "상전류(R)" else f) for f in SI.START_FEATURES]
    d = cycles.cycle_starts(cycles.active_rows(steps(spark, sf)), feats, "cycle_runtime")
    return d.select("user_id", "event_id", "ts", "cycle_runtime")


@register("samples_per_month", with_chain("steps") + """SELECT split, CAST(month AS INTEGER) AS month,
  CAST(GROUPING(split, month) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts,
  max(ts) AS last_ts FROM (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'train' ELSE 'test' END
  AS split, month(ts) AS month, ts FROM steps WHERE current_aeration = 1 AND elapsed_time = 0)
  GROUP BY GROUPING SETS ((split, month), (split), ())""")
def q_spm(spark, sf):
    d = cycles.split_label(starts_of(steps(spark, sf)), "ts", "2024-01-16 00:00:00")
    s = metrics.samples_per_month(d, "ts")
    return s.select("split", F.col("month").cast("int").alias("month"), F.col("level").cast("long").alias("level"),
                    "n", "first_ts", "last_ts")


SUMMARY_COLS = ["nh4", "no3", "ph", "temp", "current_r", "cycle_runtime", "elapsed_time", "T_remaining",
                "nh4_diff", "nh4_rolling_mean", "nh4_no3_ratio", "do_saturation"]


@register("table_summary", with_chain("steps") + f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in SUMMARY_COLS)}) AS BIGINT) AS n_nulls,
  CAST(count(*) FILTER (WHERE T_remaining < 0) AS BIGINT) AS n_negative_remaining
  FROM steps GROUP BY ROLLUP (user_id)""")
def q_summary(spark, sf):
    d = steps(spark, sf).select("user_id", *SUMMARY_COLS)
    return metrics.table_summary(d, "user_id")


@register("end_quantile", with_chain("steps") + """SELECT CAST(count(v) AS BIGINT) AS n_runs,
  round(quantile_cont(v, 0.95), 6) AS quantile FROM (SELECT user_id, run_id, arg_max(nh4, pos) AS v FROM steps
  WHERE current_aeration = 1 GROUP BY user_id, run_id)""")
def q_end_quantile(spark, sf):
    d = steps(spark, sf).filter(F.col("current_aeration") == 1)
    return metrics.end_quantile(d, ["user_id"], "run_id", POS, "nh4").select("n_runs", r6("quantile"))


SCALE_FEATS = [("current_r" if f == "상전류(R)" else f) for f in LSTM_FEATURES]


def _scale_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                      for c in SCALE_FEATS)
    cols = ", ".join(f"round(least(greatest(({c} - m_{c}) / s_{c}, -5.0), 5.0), 6) AS {c}" for c in SCALE_FEATS)
    return (with_chain("steps") + f""", act AS (SELECT * FROM steps WHERE current_aeration = 1),
  st AS (SELECT {stats} FROM act WHERE ts < TIMESTAMP '2024-01-16 00:00:00')
  SELECT event_id, {cols} FROM act, st""")


@register("scale_clip", _scale_sql())
def q_scale(spark, sf):
    act = steps(spark, sf).filter(F.col("current_aeration") == 1)
    params = features.fit_scaler(act.filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")),
                                 SCALE_FEATS)
    return features.apply_scaler(act, params).select("event_id", *[r6(c) for c in SCALE_FEATS])


@register("top_features", with_chain("steps") + """SELECT feature, round(score, 6) AS score,
  CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS rank FROM (
  UNPIVOT (SELECT """ + ", ".join(f"abs(corr({c}, T_remaining)) AS {c}" for c in SCALE_FEATS if c != "elapsed_time")
          + """ FROM steps WHERE current_aeration = 1) ON COLUMNS(*) INTO NAME feature VALUE score)
  ORDER BY score DESC, feature LIMIT 5""")
def q_top(spark, sf):
    act = steps(spark, sf).filter(F.col("current_aeration") == 1)
    cols = [c for c in SCALE_FEATS if c != "elapsed_time"]
    wide = act.agg(*[F.abs(F.corr(c, "T_remaining")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "score")
    from ..operators.models import top_features
    return top_features(long, "feature", "score", 5).select("feature", r6("score"), "rank")


@register("sliding_sequences", with_chain("cno") + """SELECT user_id, event_id, elapsed_time, T_remaining, seq FROM (
  SELECT *, count(*) OVER w7 AS len, array_to_string(list(CAST(floor(nh4 * 100 + 0.5) AS BIGINT)) OVER w7, ',') AS seq
  FROM cno WINDOW w7 AS (PARTITION BY user_id, cycle_no ORDER BY opos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  WHERE len = 7""")
def q_sliding(spark, sf):
    d = features.sliding_sequences(run_cycles(spark, sf), SPEC, ["nh4", "elapsed_time"], 7, "cycle_no")
    d = d.filter(F.col("current_aeration") == 1)
    seq = F.array_join(F.transform("window", lambda s: F.floor(s["nh4"] * 100 + 0.5).cast("long").cast("string")), ",")
    return d.select("user_id", "event_id", "elapsed_time", "T_remaining", seq.alias("seq"))


@register("ordered_output", with_chain("steps") + """SELECT user_id, ts, event_id, cycle_runtime FROM steps
  WHERE current_aeration = 1 ORDER BY user_id, ts NULLS LAST, event_id""")
def q_ordered(spark, sf):
    d = cycles.active_rows(steps(spark, sf))
    return d.select("user_id", "ts", "event_id", "cycle_runtime").orderBy(
        F.col("user_id").asc_nulls_last(), F.col("ts").asc_nulls_last(), "event_id")


# second part registers sources/sinks, streaming and model queries
from . import registry_more  # noqa: E402,F401
