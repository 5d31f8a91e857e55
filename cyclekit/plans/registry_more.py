"""Registry, part two: sources/sinks, streaming and model queries."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain, models, sketches
from ..operators.artefacts import ModelStore, missing_features
from ..operators.series import POS, materialize
from ..schema import (AUDIT_SCHEMA, CYCLE_SPEC, LSTM_FEATURES, MAX_T_SIGNAL, MIN_T_SIGNAL, QUALITY_SCHEMA, STEP_FIELDS, STEP_SPEC, WINDOW_SIZE,
                      XGB_FEATURES, FeatureSpec)
from ..session import ensure_checkpoint_dir
from ..sources.readers import read_sensor_csv
from ..sources.sinks import MetricStore, append_audit, metric_rows, upsert_metrics, write_features
from ..streaming import control as ST
from ..streaming.online import ChainPaths, append_slice, chain_tables, run_chain
from . import standin as SI
from .registry import (NAME_SQL, R6, STEP_COLS, _step_select, _step_sql, name_col, r6, register, replayed, starts_of, steps)
from .standin import table, with_chain


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


# ================================================================ IO1, IO3, IO4, IO6
@register("write_roundtrip", with_chain("aligned") + f"""SELECT event_id, user_id, user_id % 2 AS site,
  {R6('nh4')}, {R6('no3')} FROM aligned""")
def q_write_roundtrip(spark, sf):
    path = scratch_path(spark, "features")
    d = SI.aligned(spark, sf).withColumn("site", F.col("user_id") % 2)
    write_features(d, path, partition_by=["site"])
    back = spark.read.parquet(path)
    return back.select("event_id", "user_id", F.col("site").cast("long").alias("site"), r6("nh4"), r6("no3"))


CSV_TS_SQL = "strftime(ts, '%-m월%-d월%y %-H:%M')"


@register("read_sensor_csv", f"""SELECT {NAME_SQL} AS "계측기명", {CSV_TS_SQL} AS "수집시간",
  value AS nh4, value / 10 AS no3, 7.0 AS ph, 15.0 AS temp FROM events""")
def q_read_sensor_csv(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(name_col().alias("계측기명"), F.date_format("ts", "M'월'd'월'yy H:mm").alias("수집시간"),
                    F.col("value").alias("nh4"), F.lit(None).cast("string").alias("_unnamed"),
                    (F.col("value") / 10).alias("no3"), F.lit(7.0).alias("ph"), F.lit(15.0).alias("temp"),
                    F.col("event_type"))
    base = scratch_path(spark, "csv")
    with_header = rows.filter(F.col("event_type").isin("view", "click")).drop("event_type")
    headerless = rows.filter(~F.col("event_type").isin("view", "click")).drop("event_type")
    with_header.write.option("header", "true").csv(f"{base}/with_header")
    headerless.write.option("header", "false").csv(f"{base}/headerless")
    d = read_sensor_csv(spark, [f"{base}/with_header", f"{base}/headerless"], QUALITY_SCHEMA, "계측기명")
    return d.select("계측기명", "수집시간", "nh4", "no3", "ph", "temp")


METRIC_SQL = """WITH old AS (
  SELECT event_type AS section, 'avg_value' AS metric, round(avg(value), 6) AS value, min(ts) AS updated_at
  FROM events GROUP BY event_type
  UNION ALL SELECT event_type, 'n_rows', CAST(count(*) AS DOUBLE), min(ts) FROM events GROUP BY event_type),
new AS (
  SELECT event_type AS section, 'avg_value' AS metric, round(avg(value), 6) AS value, max(ts) AS updated_at
  FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY event_type
  UNION ALL SELECT event_type, 'max_value', max(value), max(ts) FROM events
  WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY event_type),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT section, metric, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY section, metric
  ORDER BY updated_at DESC NULLS LAST) AS r FROM u) WHERE r = 1"""


@register("metrics_upsert", METRIC_SQL)
def q_metrics_upsert(spark, sf):
    e = table(spark, sf, "events")
    old = (e.groupBy(F.col("event_type").alias("section"))
           .agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count(F.lit(1)).cast("double").alias("n_rows"),
                F.min("ts").alias("updated_at"))
           .unpivot(["section", "updated_at"], ["avg_value", "n_rows"], "metric", "value"))
    late = e.filter(F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    new = (late.groupBy(F.col("event_type").alias("section"))
           .agg(F.round(F.avg("value"), 6).alias("avg_value"), F.max("value").alias("max_value"),
                F.max("ts").alias("updated_at"))
           .unpivot(["section", "updated_at"], ["avg_value", "max_value"], "metric", "value"))
    return upsert_metrics(old, new).select("section", "metric", "value", "updated_at")


_AUDIT_DOUBLES = [f.name for f in AUDIT_SCHEMA.fields if f.dataType.typeName() == "double"]
_AUDIT_REST = ["weekday", "elapsed_time", "t_signal", "should_continue", "was_clamped", "mode"]


@register("audit_append", with_chain("replayed") + f"""SELECT sha256(concat_ws('|', user_id, event_id)) AS request_id,
  sha256(CAST(user_id AS VARCHAR) || '|' || strftime(min(ts) OVER (PARTITION BY user_id, cycle_no), '%Y-%m-%d %H:%M:%S'))[:32]
  AS cycle_id, CAST(user_id AS VARCHAR) AS reactor, {', '.join(R6(c) for c in _AUDIT_DOUBLES)},
  {', '.join(_AUDIT_REST)}, ts AS "timestamp" FROM replayed""")
def q_audit_append(spark, sf):
    """Every column of the audit table; the batch is written twice and must appear once."""
    path = scratch_path(spark, "audit")
    d = materialize(replayed(spark, sf))        # used three times
    began = d.groupBy("user_id", "cycle_no").agg(F.min("ts").alias("_began"))
    d = d.join(began, ["user_id", "cycle_no"])
    reactor = F.col("user_id").cast("string")
    d = d.select(
        F.sha2(F.concat_ws("|", reactor, F.col("event_id").cast("string")), 256).alias("request_id"),
        F.substring(F.sha2(F.concat_ws("|", reactor, F.date_format("_began", "yyyy-MM-dd HH:mm:ss")), 256), 1, 32).alias("cycle_id"),
        reactor.alias("reactor"), *_AUDIT_DOUBLES, *_AUDIT_REST, F.col("ts").alias("timestamp"))
    append_audit(d, path, batch_id=0, partition_by=("date",))
    append_audit(d, path, batch_id=0, partition_by=("date",))   # a replayed batch: must not duplicate rows
    back = spark.read.parquet(path)
    return back.select("request_id", "cycle_id", F.col("reactor").cast("string").alias("reactor"),
                       *[r6(c) for c in _AUDIT_DOUBLES], *_AUDIT_REST, "timestamp")


# ================================================================ A14 and models
@register("sample_n", with_chain("steps") + f"""SELECT user_id, event_id, {R6('nh4')}, cycle_runtime FROM steps
  WHERE current_aeration = 1 AND elapsed_time = 0 AND ts >= TIMESTAMP '2024-01-16 00:00:00'
  ORDER BY md5(concat_ws('|', '42', user_id, event_id)), user_id, event_id LIMIT 1000""")
def q_sample_n(spark, sf):
    test = starts_of(steps(spark, sf)).filter(F.col("ts") >= F.lit(SPLIT_AT).cast("timestamp_ntz"))
    return models.sample_n(test, ["user_id", "event_id"], 1000).select("user_id", "event_id", r6("nh4"), "cycle_runtime")


START_FEATS = [("current_r" if f == "상전류(R)" else f) for f in XGB_FEATURES if f != "reactor"]
STEP_FEATS = [("current_r" if f == "상전류(R)" else f) for f in LSTM_FEATURES]
START_SPEC = FeatureSpec("cycle_start", tuple(START_FEATS), CYCLE_SPEC.target, CYCLE_SPEC.forbidden,
                         tuple(m for f, m in zip(XGB_FEATURES, CYCLE_SPEC.monotone) if f != "reactor"))
WINDOW_SPEC = FeatureSpec("step", tuple(STEP_FEATS), STEP_SPEC.target, STEP_SPEC.forbidden, extra={"window": WINDOW_SIZE})
SPLIT_AT = "2024-01-16 00:00:00"
VALID_FROM = "2024-01-11 00:00:00"
SPLIT = {"test_from": SPLIT_AT, "validation_from": VALID_FROM}
ML_PARAMS = models.GBTParams()


def model_store(spark, sf) -> ModelStore:
    """The models of this application and input: a model is fitted once and loaded by every
    other query."""
    tag = hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf}".encode()).hexdigest()[:16]
    return ModelStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/models-{tag}")


def _split(d: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return (d.withColumn("split", F.when(ts < F.lit(SPLIT_AT).cast("timestamp_ntz"), "train").otherwise("test"))
             .withColumn("is_val", ts >= F.lit(VALID_FROM).cast("timestamp_ntz")))


def _start_frame(spark, sf, st: DataFrame | None = None) -> DataFrame:
    st = steps(spark, sf, staged=True) if st is None else st
    d = starts_of(st).select("user_id", "event_id", "ts", *START_FEATS, "cycle_runtime")
    return materialize(_split(d))       # fits and audits read it many times


def _fit_start(d: DataFrame):
    return models.fit_contract(d.filter(F.col("split") == "train"), START_SPEC, ML_PARAMS, validation_col="is_val")


def _start_model(spark, sf, st: DataFrame | None = None):
    """(saved start model, start rows); ``st`` is the step table, if the caller has it staged."""
    store, d = model_store(spark, sf), _start_frame(spark, sf, st)
    if not store.versions("start"):
        store.save("start", _fit_start(d), START_SPEC, split=SPLIT)
    return store.load("start").model, d


def _window_frame(spark, sf, scaler: dict | None, st: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Flattened scaled windows (``flat``) of every on-row that has one; the scaler is fitted on
    the training rows unless given."""
    from ..operators.features import apply_scaler, fit_scaler, sliding_sequences, window_matrix
    from ..operators.cycles import run_cycle_no
    full = run_cycle_no(materialize(steps(spark, sf, staged=True)) if st is None else st)
    on = full.filter(F.col("current_aeration") == 1)
    params = scaler or fit_scaler(on.filter(F.col("ts") < F.lit(SPLIT_AT).cast("timestamp_ntz")), STEP_FEATS)
    z = [f"{c}_z" for c in STEP_FEATS]
    win = sliding_sequences(apply_scaler(full, params, suffix="_z"), SI.SPEC, z, WINDOW_SIZE, "cycle_no").filter(F.col("current_aeration") == 1)
    flat = window_matrix(win, "window", z, "flat").select("user_id", "event_id", "ts", POS, "T_remaining", "flat")
    return materialize(_split(flat)), params


def _step_model(spark, sf, st: DataFrame | None = None):
    store = model_store(spark, sf)
    if not store.versions("step"):
        d, scaler = _window_frame(spark, sf, None, st)
        WINDOW_SPEC.assert_valid()
        model = models.fit_window_model(d.filter(F.col("split") == "train"), "flat", WINDOW_SPEC.target, ML_PARAMS, validation_col="is_val")
        store.save("step", model, WINDOW_SPEC, scaler, SPLIT)
        return store.load("step"), d
    saved = store.load("step")
    return saved, _window_frame(spark, sf, saved.scaler, st)[0]


@register("cycle_model_scores")
def q_cycle_model(spark, sf):
    model, d = _start_model(spark, sf)
    s = models.score(model, d.filter(F.col("split") == "test"))
    return s.select("user_id", "event_id", "cycle_runtime", r6("pred"))


_TEST_STARTS = f"""SELECT * FROM steps WHERE current_aeration = 1 AND elapsed_time = 0 AND ts >= TIMESTAMP '{SPLIT_AT}'"""


@register("model_reload", with_chain("steps") + f"""SELECT count(*) AS n_rows, 0::BIGINT AS n_unscored, count(*) AS n_scored,
  0::BIGINT AS n_differ, 0::BIGINT AS n_negative, {len(START_FEATS)}::INTEGER AS n_features FROM ({_TEST_STARTS})""")
def q_model_reload(spark, sf):
    """Save a fit, load it again, score the test starts with both: every row has a score, none
    differs, none is negative; the loaded contract names the features."""
    d = _start_frame(spark, sf)
    fitted = _fit_start(d)
    store = ModelStore(spark, scratch_path(spark, "reload"))
    store.save("start", fitted, START_SPEC, split=SPLIT)
    loaded = store.load("start")
    test = d.filter(F.col("split") == "test")
    both = models.score(fitted, test, "a").join(models.score(loaded.model, test, "b").select("user_id", "event_id", "b"), ["user_id", "event_id"])
    out = both.agg(F.count("a").alias("n_scored"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("n_differ"),
                   F.count(F.when((F.col("a") < 0) | (F.col("b") < 0), 1)).alias("n_negative"))
    lost = missing_features(test, list(loaded.spec.features))                  # one row each
    return lost.join(F.broadcast(out)).select("n_rows", "n_unscored", "n_scored", "n_differ", "n_negative",
                                              F.lit(len(loaded.spec.features)).alias("n_features"))


@register("feature_importance")
def q_importance(spark, sf):
    model, _ = _start_model(spark, sf)
    path = scratch_path(spark, "importance")
    write_features(models.feature_importance(model, START_FEATS, spark), path)   # IO5
    return spark.read.parquet(path)


@register("permutation_importance")
def q_permutation(spark, sf):
    model, d = _start_model(spark, sf)
    test = d.filter(F.col("split") == "test")
    path = scratch_path(spark, "permutation")
    write_features(models.permutation_importance(model, test, START_FEATS, "cycle_runtime",
                                                 ["user_id", "event_id"]), path)   # IO5
    return spark.read.parquet(path)


@register("monotone_audit")
def q_monotone(spark, sf):
    model, d = _start_model(spark, sf)
    test = d.filter(F.col("split") == "test")
    return models.monotone_audit(model, test, START_FEATS, ["nh4", "nh4_rolling_mean"], ["user_id", "event_id"])


@register("step_model_scores")
def q_step_model(spark, sf):
    saved, d = _step_model(spark, sf)
    s = models.score_windows(saved.model, d.filter(F.col("split") == "test"), "flat")
    return s.select("user_id", "event_id", "T_remaining", r6("pred"))


@register("contribution_importance")
def q_contribution_importance(spark, sf):
    """Mean absolute contributions, stored (IO5) and read back; ``contribution_sums`` checks the parts."""
    parts, _ = _contributions(spark, sf)
    path = scratch_path(spark, "contributions")
    write_features(explain.contribution_importance(parts, START_FEATS), path)
    return spark.read.parquet(path)


def _contributions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(contributions, raw predictions) of the test starts under the saved start model."""
    model, d = _start_model(spark, sf)
    test = d.filter(F.col("split") == "test")
    nodes = explain.tree_nodes(model, scratch_path(spark, "trees"))
    parts = materialize(explain.contributions(test, nodes, START_FEATS, ["user_id", "event_id"], ML_PARAMS.max_depth))
    return parts, model.transform(test).select("user_id", "event_id", "prediction")


@register("contribution_sums", with_chain("steps") + f"SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM ({_TEST_STARTS})")
def q_contribution_sums(spark, sf):
    """Base and contributions sum to the prediction on every row."""
    parts, raw = _contributions(spark, sf)
    total = F.col("base")
    for f in START_FEATS:
        total = total + F.col(f"c_{f}")
    both = parts.join(raw, ["user_id", "event_id"])
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.abs(total - F.col("prediction")) > 1e-6, 1)).alias("n_off"))


@register("monotone_start_model", with_chain("steps") + f"""SELECT 'nh4' AS feature, 10 * count(*) AS n_points, 0::BIGINT AS n_decreasing, 0::BIGINT AS n_lowered
  FROM ({_TEST_STARTS})""")
def q_monotone_start_model(spark, sf):
    """The start model corrected over nh4: the audit counts no fall, and no prediction is lowered."""
    model, d = _start_model(spark, sf)
    test = d.filter(F.col("split") == "test")
    nodes = explain.tree_nodes(model, scratch_path(spark, "trees"))
    nodes = materialize(nodes)

    def corrected(rows: DataFrame, keys: list[str]) -> DataFrame:
        return explain.monotone_score(model, nodes, rows, START_FEATS, "nh4", keys)

    audit = models.monotone_audit(corrected, test, START_FEATS, ["nh4"], ["user_id", "event_id"])
    keys = ["user_id", "event_id"]
    both = corrected(test, keys).select(*keys, "pred").join(models.score(model, test, "plain").select(*keys, "plain"), keys)
    lowered = both.agg(F.count(F.when(F.col("pred") < F.col("plain") - 1e-9, 1)).alias("n_lowered"))
    return audit.join(F.broadcast(lowered)).select("feature", "n_points", "n_decreasing", "n_lowered")      # one row each


_TEST_WINDOWS = f"""SELECT * FROM steps WHERE current_aeration = 1 AND run_pos >= {WINDOW_SIZE - 1} AND ts >= TIMESTAMP '{SPLIT_AT}'"""


@register("step_baseline", with_chain("steps") + f"""SELECT count(*) AS n_rows, 0::BIGINT AS n_negative, true AS huber_beats_mean
  FROM ({_TEST_WINDOWS})""")
def q_step_baseline(spark, sf):
    """The robust linear baseline beside the step model, on the test windows: both score every
    window, neither below zero, and the baseline's mean absolute error is less than that of
    the training mean."""
    saved, d = _step_model(spark, sf)
    train, test = d.filter(F.col("split") == "train"), d.filter(F.col("split") == "test")
    huber = models.fit_huber(train, "flat", "T_remaining")
    both = models.score_windows(saved.model, models.score_windows(huber, test, "flat", "h"), "flat", "g")
    mean = train.agg(F.avg("T_remaining").alias("mean"))                                  # one row
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("T_remaining")))
    return both.join(F.broadcast(mean)).agg(
        F.count(F.when(F.col("h").isNotNull() & F.col("g").isNotNull(), 1)).alias("n_rows"),
        F.count(F.when((F.col("h") < 0) | (F.col("g") < 0), 1)).alias("n_negative"),
        (err("h") < err("mean")).alias("huber_beats_mean"))


def model_replay(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(back-test with both saved models, test starts with the start model's prediction): the step
    model's scores reach their rows by series position."""
    from ..operators import control
    from ..operators.series import join_small
    from .registry import SPEC
    st = materialize(steps(spark, sf, staged=True))       # one build for the starts, the windows and the replay
    model, d = _start_model(spark, sf, st)
    scored = models.score(model, d.filter(F.col("split") == "test"), "start_model_pred").select(
        "user_id", "ts", "event_id", "cycle_runtime", "start_model_pred")
    saved, windows = _step_model(spark, sf, st)
    ahead = models.score_windows(saved.model, windows, "flat", "step_model_pred").select("user_id", POS, "step_model_pred")
    st = join_small(st, ahead, ["user_id", POS], "left")
    rep = control.replay(st, scored, SPEC, "start_model_pred", F.col("step_model_pred"))
    every = starts_of(st).join(scored.select("user_id", "event_id", "start_model_pred"), ["user_id", "event_id"], "left")
    return rep, every


@register("model_backtest")
def q_model_backtest(spark, sf):
    """Replay the test cycles with both fitted models and report the stop KPIs with the number of
    skipped cycles."""
    from ..operators import control, metrics
    rep, every = model_replay(spark, sf)
    kpis = metrics.stop_kpis(control.cycle_outcomes(rep, ["user_id"], "cycle_no"))
    return kpis.join(F.broadcast(control.skipped_cycles(every, "start_model_pred")))   # one row each


@register("model_backtest_rows", with_chain("cno") + f""", first AS (SELECT user_id, cycle_no, min(ts) AS began FROM cno GROUP BY user_id, cycle_no),
  t AS (SELECT c.*, row_number() OVER (PARTITION BY c.user_id, c.cycle_no ORDER BY opos) AS k FROM cno c JOIN first f
    ON f.user_id = c.user_id AND f.cycle_no = c.cycle_no WHERE began >= TIMESTAMP '{SPLIT_AT}')
SELECT user_id, event_id, cycle_no, elapsed_time, CAST(least(7, k) AS INTEGER) AS buffer_fill,
  CASE WHEN elapsed_time < 60 OR k < 7 THEN 'xgb_only' ELSE 'integrated' END AS mode, elapsed_time >= 60 AND k >= 7 AS has_step_pred, true AS in_bounds FROM t""")
def q_model_backtest_rows(spark, sf):
    """The rows of the two-model back-test: which cycles are replayed, in which mode, where a step
    prediction reached the row, and that every signal is within its bounds and never below
    the step prediction."""
    rep, _ = model_replay(spark, sf)
    step = F.col("mode") == "integrated"
    bounded = F.col("t_signal").between(MIN_T_SIGNAL, MAX_T_SIGNAL)
    above = ~step | (F.col("t_signal") >= F.least(F.floor("step_model_pred"), F.lit(MAX_T_SIGNAL)))
    return rep.select("user_id", "event_id", "cycle_no", "elapsed_time", "buffer_fill", "mode",
                      (step & F.col("step_model_pred").isNotNull()).alias("has_step_pred"), (bounded & above).alias("in_bounds"))


# ================================================================ streaming (ST1-ST5)
def control_events(spark, sf, drop_features: bool = False) -> DataFrame:
    """Control events derived from the step table: one start per cycle (on-row with
    elapsed 0, carrying the start model's raw prediction) and one tick per on-row.
    Every on-row belongs to a run that starts at elapsed 0, so these are exactly
    the cycles the batch back-test replays."""
    kinds = F.when(F.col("elapsed_time") == 0, F.array(F.lit("start"), F.lit("tick"))).otherwise(F.array(F.lit("tick")))
    rep = steps(spark, sf, staged=True).filter(F.col("current_aeration") == 1).withColumn("event_kind", F.explode(kinds))     # one pass over the step table
    tick = F.col("event_kind") == "tick"
    dropped = set(ST.RUN_FEATURES) if drop_features else set()
    sensors = [(F.when(~tick, F.col(c)) if c in dropped else F.col(c)).cast("double").alias(c) for c in ST.SENSOR_FIELDS]
    events = rep.select("event_kind", F.col("ts").alias("event_time"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("reactor"),
                        F.col("elapsed_time").cast("int"), F.when(~tick, SI.start_pred_expr()).alias("start_pred_raw"), *sensors, F.col("weekday").cast("int"))
    return events.select(*[f.name for f in ST.EVENT_SCHEMA.fields])


SLICES = 3       # time slices that a stream query's events come in, a micro-batch each


def write_slices(events: DataFrame, path: str, slices: int = SLICES, which: range | None = None) -> None:
    """Write events as files in time order, a slice of equal time span after the other."""
    t = F.unix_micros(F.col("event_time").cast("timestamp"))
    lo, hi = events.agg(F.min(t), F.max(t)).first()
    at = F.least(F.floor((t - F.lit(lo or 0)) * slices / F.lit(max(1, (hi or 0) - (lo or 0)))), F.lit(slices - 1))
    for i in which if which is not None else range(slices):
        append_slice(events.filter(at == i), path, FILES)


FILES = 4


def run_stream(spark, events: DataFrame, transform, tag: str, audit: bool = False) -> DataFrame:
    """Write ``events`` as files in time order, stream them through ``transform``, a few
    micro-batches with an availableNow trigger, into a Parquet sink via foreachBatch (the
    audit sink of ST4 when ``audit``), and return the sink as a table."""
    src, sink, ckpt = scratch_path(spark, f"{tag}-src"), scratch_path(spark, f"{tag}-sink"), \
        scratch_path(spark, f"{tag}-ckpt")
    write_slices(materialize(events), src)
    stream = spark.readStream.schema(ST.EVENT_SCHEMA).option("maxFilesPerTrigger", FILES).parquet(src)

    def sink_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink)

    writer = ST.audit_writer(sink, partition_by=("date",)) if audit else sink_batch
    q = (transform(stream).writeStream.foreachBatch(writer)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)


TICK_SQL = with_chain("replayed") + """SELECT CAST(user_id AS VARCHAR) AS reactor, event_id AS seq, elapsed_time,
  start_pred, buffer_fill, mode, t_signal, was_clamped, should_continue FROM replayed"""


@register("control_stream", TICK_SQL)
def q_control_stream(spark, sf):
    out = run_stream(spark, control_events(spark, sf), ST.control_stream, "control", audit=True)
    return out.filter(F.col("event_kind") == "tick").select(
        "reactor", "seq", "elapsed_time", "start_pred", "buffer_fill", "mode", "t_signal", "was_clamped",
        "should_continue")


@register("feature_stream", with_chain("replayed") + f"""SELECT CAST(user_id AS VARCHAR) AS reactor, event_id AS seq,
  {', '.join(R6(c) for c in ST.RUN_FEATURES)}, sha256(CAST(user_id AS VARCHAR) || '|' ||
  strftime(max(CASE WHEN elapsed_time = 0 THEN ts END) OVER (PARTITION BY user_id, cycle_no), '%Y-%m-%d %H:%M:%S'))[:32]
  AS cycle_id FROM replayed""")
def q_feature_stream(spark, sf):
    out = run_stream(spark, control_events(spark, sf, drop_features=True), ST.control_stream, "features")
    return out.filter(F.col("event_kind") == "tick").select("reactor", "seq", "cycle_id",
                                                            *[r6(c) for c in ST.RUN_FEATURES])


@register("dedupe_stream", TICK_SQL)
def q_dedupe_stream(spark, sf):
    """Every fourth tick is sent twice; the watermarked repeat filter leaves the plain back-test."""
    events = materialize(control_events(spark, sf))
    again = events.filter((F.col("event_kind") == "tick") & (F.col("elapsed_time") > 0) & (F.col("seq") % 4 == 0))
    out = run_stream(spark, events.unionByName(again), lambda s: ST.control_stream(s, dedupe_within="30 days"), "dedupe")
    return out.filter(F.col("event_kind") == "tick").select(
        "reactor", "seq", "elapsed_time", "start_pred", "buffer_fill", "mode", "t_signal", "was_clamped",
        "should_continue")


# events that the online chain must reject: a missing feature, an elapsed time off the grid, an unknown reactor
_RULE_SQL = [(f"{c}_range", " OR ".join([f"{c} IS NULL", f"{c} < {lo}"] + ([f"{c} > {hi}"] if hi is not None else [])))
             for c, lo, hi in [("nh4", 0.0, 100.0), ("no3", 0.0, 100.0), ("ph", 0.0, 14.0), ("temp", 0.0, 40.0), ("current_r", 0.0, None),
                               ("hour_sin", -1.0, 1.0), ("hour_cos", -1.0, 1.0), ("weekday", 0, 6)]]
_RULE_SQL += [("reactor_unknown", "user_id % 10 = 3"), ("elapsed_time_step", "event_kind = 'tick' AND elapsed_time % 10 <> 0"),
              ("nh4_no3_ratio_missing", "nh4_no3_ratio IS NULL")]
ONLINE_SQL = with_chain("onp") + f""", sent_events AS (
  SELECT 'tick' AS event_kind, event_id AS seq, user_id, ts, CASE WHEN event_id % 101 = 0 THEN elapsed_time + 3 ELSE elapsed_time END AS elapsed_time,
    nh4, no3, ph, temp, current_r, hour_sin, hour_cos, weekday, CASE WHEN event_id % 97 = 0 THEN NULL ELSE nh4_no3_ratio END AS nh4_no3_ratio,
    nh4_rolling_mean, NULL::DOUBLE AS start_pred_raw FROM onp
  UNION ALL SELECT 'start', event_id, user_id, ts, 0, nh4, no3, ph, temp, current_r, hour_sin, hour_cos, weekday,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE nh4_no3_ratio END, nh4_rolling_mean, {SI.START_PRED_SQL} FROM onp WHERE elapsed_time = 0),
chk AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULE_SQL)}], lambda x: x IS NOT NULL), ',') AS violations FROM sent_events),
num AS (SELECT *, sum(CASE WHEN event_kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq, event_kind ROWS UNBOUNDED PRECEDING) AS c
  FROM chk WHERE violations = ''),
st AS (SELECT user_id, c, CAST(trunc(greatest(10.0, start_pred_raw)) AS INTEGER) AS start_pred FROM num WHERE event_kind = 'start'),
tk AS (SELECT num.*, start_pred FROM num LEFT JOIN st USING (user_id, c) WHERE event_kind = 'tick'),
od AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS o FROM tk WHERE start_pred IS NOT NULL),
rs AS (SELECT *, CASE WHEN lag(c) OVER w IS DISTINCT FROM c OR elapsed_time < lag(elapsed_time) OVER w THEN 1 ELSE 0 END AS r
  FROM od WINDOW w AS (PARTITION BY user_id ORDER BY o)),
sg AS (SELECT *, sum(r) OVER (PARTITION BY user_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS s FROM rs),
bf AS (SELECT *, CAST(least(7, row_number() OVER (PARTITION BY user_id, s ORDER BY o)) AS INTEGER) AS buffer_fill FROM sg),
md AS (SELECT *, CASE WHEN elapsed_time < 60 OR buffer_fill < 7 THEN 'xgb_only' ELSE 'integrated' END AS mode FROM bf),
rw AS (SELECT *, CASE WHEN mode = 'xgb_only' THEN greatest(0.0, start_pred - elapsed_time)
  ELSE greatest(0.0, start_pred - elapsed_time, {SI.STEP_PRED_SQL}) END AS raw FROM md)
SELECT CAST(user_id AS VARCHAR) AS reactor, seq, 'tick' AS outcome, elapsed_time, {R6('nh4')}, start_pred, buffer_fill, mode,
  CAST(trunc(least(greatest(raw, 10.0), 250.0)) AS INTEGER) AS t_signal, NOT (raw >= 10.0 AND raw <= 250.0) AS was_clamped,
  CAST(trunc(least(greatest(raw, 10.0), 250.0)) AS INTEGER) > 20 AS should_continue, NULL AS violations FROM rw
UNION ALL SELECT CAST(user_id AS VARCHAR), seq, 'skipped', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM tk WHERE start_pred IS NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), seq, 'rejected ' || event_kind, elapsed_time, {R6('nh4')}, NULL, NULL, NULL, NULL, NULL, NULL, violations
  FROM chk WHERE violations <> ''"""


def chain_paths(spark, tag: str) -> ChainPaths:
    return ChainPaths(*(scratch_path(spark, f"{tag}-{part}") for part in ("events", "audit", "quarantine", "ckpt")))


def defective_events(spark, sf) -> DataFrame:
    """Control events of which some break a rule."""
    tick = F.col("event_kind") == "tick"
    return control_events(spark, sf).withColumns({
        "elapsed_time": F.when(tick & (F.col("seq") % 101 == 0), F.col("elapsed_time") + 3).otherwise(F.col("elapsed_time")),
        "nh4_no3_ratio": F.when(F.col("seq") % 97 != 0, F.col("nh4_no3_ratio"))})


class _Stopped(RuntimeError):
    pass


@register("online_chain", ONLINE_SQL)
def q_online_chain(spark, sf):
    """Validation, control and audit over four slices: the chain takes two, is broken off in the
    next (after the audit write, before the batch is committed), and goes on from its
    checkpoints."""
    events = materialize(defective_events(spark, sf))
    known = events.select("reactor").distinct().filter(F.col("reactor").cast("long") % 10 != 3)
    paths = chain_paths(spark, "online")
    known = materialize(known)
    write_slices(events, paths.source, 4, range(0, 2))
    run_chain(spark, paths, reactors=known, max_files=FILES)
    write_slices(events, paths.source, 4, range(2, 4))
    plain = ST.audit_writer(paths.audit, partition_by=("date",))

    def broken(batch: DataFrame, batch_id: int) -> None:
        plain(batch, batch_id)
        raise _Stopped(f"batch {batch_id} is written but not committed")

    try:
        run_chain(spark, paths, reactors=known, max_files=FILES, writer=broken)
    except Exception as e:  # noqa: BLE001  Spark wraps the error of a batch
        if "not committed" not in str(e):
            raise
    run_chain(spark, paths, reactors=known, max_files=FILES)
    audit, rejected = chain_tables(spark, paths)
    none = F.lit(None)
    rest = ["start_pred", "buffer_fill", "mode", "t_signal", "was_clamped", "should_continue"]
    decided = audit.filter("event_kind <> 'start'").select(
        "reactor", "seq", F.col("event_kind").alias("outcome"), "elapsed_time", r6("nh4"), *rest, none.cast("string").alias("violations"))
    return decided.unionByName(rejected.select(
        "reactor", "seq", F.concat(F.lit("rejected "), "event_kind").alias("outcome"), "elapsed_time", r6("nh4"),
        *[none.cast(audit.schema[c].dataType).alias(c) for c in rest], F.array_join("violations", ",").alias("violations")))


def _validate_sql() -> str:
    parts = []
    for c, lo, hi in [("nh4", 0.0, 100.0), ("no3", 0.0, 100.0), ("ph", 0.0, 14.0), ("temp", 0.0, 40.0),
                      ("current_r", 0.0, None), ("hour_sin", -1.0, 1.0), ("hour_cos", -1.0, 1.0),
                      ("weekday", 0, 6)]:
        cond = [f"{c} IS NULL", f"{c} < {lo}"] + ([f"{c} > {hi}"] if hi is not None else [])
        parts.append(f"CASE WHEN {' OR '.join(cond)} THEN '{c}_range' END")
    parts.append("CASE WHEN event_kind = 'tick' AND (elapsed_time IS NULL OR elapsed_time % 10 <> 0) "
                 "THEN 'elapsed_time_step' END")
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return with_chain("replayed") + f""", cev AS (
  SELECT 'tick' AS event_kind, event_id AS seq, CAST(user_id AS VARCHAR) AS reactor, elapsed_time, nh4, no3, ph,
    temp, current_r, hour_sin, hour_cos, weekday FROM replayed
  UNION ALL SELECT 'start', event_id, CAST(user_id AS VARCHAR), 0, nh4, no3, ph, temp, current_r, hour_sin,
    hour_cos, weekday FROM replayed WHERE elapsed_time = 0)
SELECT event_kind, seq, reactor, array_to_string(v, ',') AS violations, len(v) = 0 AS is_valid
FROM (SELECT *, {arr} AS v FROM cev)"""


@register("validate_stream", _validate_sql())
def q_validate_stream(spark, sf):
    def transform(stream):
        valid, bad = ST.validate_stream(stream)
        return valid.unionByName(bad)
    out = run_stream(spark, control_events(spark, sf), transform, "validate")
    return out.select("event_kind", "seq", "reactor", F.array_join("violations", ",").alias("violations"),
                      "is_valid")


# ================================================================ incremental build (ML7, IO2)
MONTH_FROM = ["2024-01-01 00:00:00", "2024-01-11 00:00:00", "2024-01-21 00:00:00", "2024-02-01 00:00:00"]


def month_files(spark, sf) -> tuple[dict[int, str], dict[int, str]]:
    """The stand-in's source files: quality and current tables of three periods."""
    d = SI.aligned(spark, sf)
    period = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(MONTH_FROM, MONTH_FROM[1:]), 1):
        period = F.when((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")), k).otherwise(period)
    part = d.withColumn("period", period).filter("period is not null")
    root = {"quality": scratch_path(spark, "quality"), "current": scratch_path(spark, "current")}
    part.drop("current_r").write.partitionBy("period").parquet(root["quality"])        # all periods in one pass over the source
    part.select("user_id", "ts", "event_id", "current_r", "period").write.partitionBy("period").parquet(root["current"])
    return tuple({k: f"{path}/period={k}" for k in range(1, len(MONTH_FROM))} for path in root.values())


def incremental_steps(spark, sf) -> DataFrame:
    """The step table built period by period, each from its own files and the state before."""
    from ..sources.readers import read_months
    from .build import BuildOptions
    from .incremental import IncrementalBuild, aligned_month
    quality, current = month_files(spark, sf)
    keys = ["user_id", "ts", "event_id"]
    build = IncrementalBuild(spark, scratch_path(spark, "incremental"), SI.SPEC, BuildOptions(threshold=SI.ON_THRESHOLD))
    for k in sorted(quality):
        rows = aligned_month(read_months(spark, {k: quality[k]}), read_months(spark, {k: current[k]}), keys, "current_r")
        build.add(rows.drop("month", "source_file"))
    build.close(rows.drop("month", "source_file"))
    return build.steps()


@register("build_incremental", with_chain("steps") + f"SELECT ts, {_step_sql(STEP_COLS)} FROM steps")
def q_build_incremental(spark, sf):
    return incremental_steps(spark, sf).select("ts", *_step_select(STEP_COLS))


@register("read_month_files", f"""SELECT event_id, user_id, ts, CAST(CASE WHEN ts < TIMESTAMP '{MONTH_FROM[1]}' THEN 1 WHEN ts < TIMESTAMP '{MONTH_FROM[2]}' THEN 2
  ELSE 3 END AS INTEGER) AS month, value AS current_r FROM events""")
def q_read_month_files(spark, sf):
    """IO2 over several files."""
    from ..sources.readers import read_months
    return read_months(spark, month_files(spark, sf)[1]).select("event_id", "user_id", "ts", "month", "current_r")


@register("cycle_table", with_chain("steps") + f"""SELECT user_id, event_id, ts, {', '.join(_step_sql([c]) for c in STEP_COLS if c not in ('user_id', 'event_id'))},
  CAST(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS reactor FROM steps WHERE current_aeration = 1""")
def q_cycle_table(spark, sf):
    """The on-rows with the fixed reactor code."""
    from ..schema import VALID_REACTORS
    from .build import cycle_table
    st = steps(spark, sf).withColumn("name", F.when(F.col("user_id") % 2 == 0, VALID_REACTORS[0]).otherwise(VALID_REACTORS[1]))
    return cycle_table(st, "name").select("ts", *_step_select(STEP_COLS), F.col("reactor").cast("int").alias("reactor"))


# ================================================================ metrics store and sketches (IO6, A10, A15)
_KPI_NAMES = ["n_cycles", "n_stopped", "no_stop_rate", "avg_time_saved", "unsafe_early_stop_rate", "avg_overrun", "nh4_risk_rate"]
_STAGE_CASE = "CASE WHEN elapsed_time <= 30 THEN '0~30' WHEN elapsed_time <= 90 THEN '31~90' ELSE '91+' END"


def _store_sql() -> str:
    kpis = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _KPI_NAMES)
    return with_chain("outc") + f""", k AS (SELECT user_id % 2 AS site, count(*) AS n_cycles, count(stop_elapsed) AS n_stopped,
    avg(CASE WHEN stop_elapsed IS NULL THEN 1.0 ELSE 0.0 END) AS no_stop_rate, coalesce(avg(CAST(actual_runtime - stop_elapsed AS DOUBLE)), 0.0) AS avg_time_saved,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN actual_runtime - stop_elapsed > 20 THEN 1.0 ELSE 0.0 END END), 0.0) AS unsafe_early_stop_rate,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN greatest(0.0, CAST(stop_elapsed - actual_runtime AS DOUBLE)) END), 0.0) AS avg_overrun,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN stop_nh4 > 5.0 THEN 1.0 ELSE 0.0 END END), 0.0) AS nh4_risk_rate FROM outc GROUP BY 1),
  s AS (SELECT user_id % 2 AS site, {_STAGE_CASE} AS stage, avg(abs(CAST(t_signal - T_remaining AS DOUBLE))) AS mae,
    sqrt(avg(CAST(t_signal - T_remaining AS DOUBLE) ** 2)) AS rmse, CAST(count(*) AS DOUBLE) AS n FROM replayed GROUP BY 1, 2)
SELECT 'stop_kpis/site=' || site AS section, metric, round(value, 6) AS value, TIMESTAMP '2024-02-01 00:00:00' AS updated_at
  FROM (UNPIVOT (SELECT site, {kpis} FROM k) ON {', '.join(_KPI_NAMES)} INTO NAME metric VALUE value)
UNION ALL SELECT 'stage_metrics/site=' || site || '/stage=' || stage, metric, round(value, 6), TIMESTAMP '2024-02-01 00:00:00'
  FROM (UNPIVOT s ON mae, rmse, n INTO NAME metric VALUE value)
UNION ALL SELECT 'model', 'n_features', {float(len(START_FEATS))}, TIMESTAMP '2024-01-01 00:00:00'"""


@register("metrics_store", _store_sql())
def q_metrics_store(spark, sf):
    """KPIs and stage metrics of both sites through the versioned store: an early version with a
    model metric and stale values, then the values of the back-test over it."""
    from ..operators import control, metrics
    rep = materialize(replayed(spark, sf).withColumn("site", F.col("user_id") % 2))
    kpis = metrics.stop_kpis(control.cycle_outcomes(rep, ["user_id", "site"], "cycle_no"), group=["site"])
    stages = metrics.stage_metrics(rep, "t_signal", "T_remaining", "elapsed_time", ["site"])
    store = MetricStore(spark, scratch_path(spark, "metrics"))
    now = metric_rows(kpis, "stop_kpis", "2024-02-01 00:00:00", _KPI_NAMES, ["site"]).unionByName(
        metric_rows(stages, "stage_metrics", "2024-02-01 00:00:00", ["mae", "rmse", "n"], ["site", "stage"]))
    now = materialize(now)
    stale = now.withColumn("value", F.lit(-1.0)).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    model = spark.range(1).select(F.lit(float(len(START_FEATS))).alias("n_features"))
    store.upsert(stale.unionByName(metric_rows(model, "model", "2024-01-01 00:00:00")))
    store.upsert(now)
    return store.read().select("section", "metric", r6("value"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


_QS = [0.25, 0.5, 0.75, 0.95]


@register("sketch_quantiles", "SELECT user_id % 2 AS site, CAST(count(value) AS BIGINT) AS n, true AS within FROM events "
          f"WHERE ts >= TIMESTAMP '{MONTH_FROM[1]}' GROUP BY 1")
def q_sketch_quantiles(spark, sf):
    """Sketches per site and day, stored, merged over a range of days: the exact ranks of the quantiles
    they give are within the sketch's error."""
    e = table(spark, sf, "events").select((F.col("user_id") % 2).alias("site"), "ts", "value")
    path = scratch_path(spark, "sketches")
    sketches.quantile_sketches(e, ["site", F.to_date("ts").alias("day")], "value").write.parquet(path)
    since = F.lit(MONTH_FROM[1])
    got = sketches.merged_quantiles(spark.read.parquet(path).filter(F.col("day") >= since.cast("date")), _QS, ["site"])
    got = materialize(got)                                                   # one row a site
    rows = e.filter(F.col("ts") >= since.cast("timestamp_ntz")).join(got.select("site", "quantiles"), "site")
    ranks = rows.groupBy("site").agg(*[x for i in range(len(_QS)) for x in (
        F.avg((F.col("value") < F.get("quantiles", F.lit(i))).cast("double")).alias(f"below{i}"),
        F.avg((F.col("value") <= F.get("quantiles", F.lit(i))).cast("double")).alias(f"upto{i}"))])
    err = 2 * sketches.RANK_ERROR
    within = F.lit(True)
    for i, q in enumerate(_QS):
        within = within & (F.col(f"below{i}") <= q + err) & (F.col(f"upto{i}") >= q - err)
    return got.join(ranks, "site").select("site", "n", within.alias("within"))


# ================================================================ whole comparisons and branches
def _report_sql() -> str:
    d = "CAST(t_signal - T_remaining AS DOUBLE)"
    parts = [
        ("'errors'", f"avg(abs({d})) AS mae, sqrt(avg({d} * {d})) AS rmse, CAST(count(*) AS DOUBLE) AS n, "
                     "avg(CASE WHEN t_signal < T_remaining - 20 THEN 1.0 ELSE 0.0 END) AS underprediction_rate", "replayed", "GROUP BY 1"),
        ("'late'", ", ".join(f"avg(abs({d})) FILTER (WHERE elapsed_time >= {lo}) AS {n}_mae, sqrt(avg({d} * {d}) FILTER (WHERE elapsed_time >= {lo})) AS {n}_rmse, "
                             f"CAST(count(*) FILTER (WHERE elapsed_time >= {lo}) AS DOUBLE) AS {n}_n" for n, lo in (("late", 91), ("integrated", 60))), "replayed", "GROUP BY 1"),
        ("'target'", f"CASE WHEN avg(abs({d})) FILTER (WHERE elapsed_time >= 91) < 30 THEN 1.0 ELSE 0.0 END AS mae_pass, "
                     f"CASE WHEN sqrt(avg({d} * {d}) FILTER (WHERE elapsed_time >= 91)) < 45 THEN 1.0 ELSE 0.0 END AS rmse_pass", "replayed", "GROUP BY 1"),
        ("'stop'", """CAST(count(*) AS DOUBLE) AS n_cycles, CAST(count(stop_elapsed) AS DOUBLE) AS n_stopped,
    avg(CASE WHEN stop_elapsed IS NULL THEN 1.0 ELSE 0.0 END) AS no_stop_rate, coalesce(avg(CAST(actual_runtime - stop_elapsed AS DOUBLE)), 0.0) AS avg_time_saved,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN actual_runtime - stop_elapsed > 20 THEN 1.0 ELSE 0.0 END END), 0.0) AS unsafe_early_stop_rate,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN greatest(0.0, CAST(stop_elapsed - actual_runtime AS DOUBLE)) END), 0.0) AS avg_overrun,
    coalesce(avg(CASE WHEN stop_elapsed IS NOT NULL THEN CASE WHEN stop_nh4 > 5.0 THEN 1.0 ELSE 0.0 END END), 0.0) AS nh4_risk_rate""", "outc", "GROUP BY 1"),
        (f"'stage ' || {_STAGE_CASE}", f"avg(abs({d})) AS mae, sqrt(avg({d} * {d})) AS rmse, CAST(count(*) AS DOUBLE) AS n", "replayed", "GROUP BY 1, 2"),
    ]
    long = " UNION ALL ".join(f"SELECT section, metric, site, value FROM (UNPIVOT (SELECT user_id % 2 AS site, {section} AS section, {cols} FROM {source} GROUP BY 1, 2) "
                              f"ON COLUMNS(* EXCLUDE (site, section)) INTO NAME metric VALUE value)" for section, cols, source, _ in parts)
    return with_chain("outc") + f""", long AS ({long})
SELECT section, metric, round(max(value) FILTER (WHERE site = 0), 6) AS value_site0, round(max(value) FILTER (WHERE site = 1), 6) AS value_site1
  FROM long GROUP BY section, metric"""


@register("site_report", _report_sql())
def q_site_report(spark, sf):
    from ..operators import control, joins
    rep = materialize(replayed(spark, sf).withColumn("site", F.col("user_id") % 2))         # read by every part
    out = control.cycle_outcomes(rep, ["user_id", "site"], "cycle_no")
    return joins.site_report(rep, out, "site", [0, 1]).select("section", "metric", r6("value_site0"), r6("value_site1"))


@register("despike_strict", with_chain("sent") + f""", spk15 AS (SELECT *, quantile_cont(no3, 0.5) OVER w5 AS med, coalesce(stddev_samp(no3) OVER w5, 1.0) AS sd
  FROM sent WINDOW w5 AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT user_id, event_id, round(CASE WHEN abs(no3 - med) > 1.5 * sd THEN NULL ELSE no3 END, 6) AS no3 FROM spk15""")
def q_despike_strict(spark, sf):
    """W9's deviation branch: at k = 1.5 it removes values (at 5 a window of five rows never can)."""
    from ..operators import clean
    from ..operators.series import with_position
    d = clean.null_sentinel(with_position(SI.aligned(spark, sf), SI.SPEC), ["nh4", "ph"])
    return clean.despike(d, SI.SPEC, "no3", k=1.5, abs_threshold=None).select("user_id", "event_id", r6("no3"))


@register("cycle_starts_raw", with_chain("steps") + """SELECT s.user_id, s.event_id, s.cycle_runtime FROM steps s JOIN clean c ON c.user_id = s.user_id AND c.pos = s.pos
  WHERE s.current_aeration = 1 AND s.elapsed_time = 0 AND c.nh4 IS NOT NULL AND c.no3 IS NOT NULL AND c.ph IS NOT NULL""")
def q_cycle_starts_raw(spark, sf):
    """P10 without interpolation: starts with a missing measurement are dropped."""
    from ..operators import cycles
    from .build import build_dataset
    d = build_dataset(SI.aligned(spark, sf), SI.SPEC, threshold=SI.ON_THRESHOLD, interp_cols=[])
    return cycles.cycle_starts(cycles.active_rows(d), ["nh4", "no3", "ph", "temp"], "cycle_runtime").select("user_id", "event_id", "cycle_runtime")


@register("split_cycle_id", with_chain("cno") + f""", sp AS (SELECT *, CASE WHEN ts < TIMESTAMP '{SPLIT_AT}' THEN 'train' ELSE 'test' END AS split FROM cno)
SELECT user_id, event_id, split, CAST(sum(CASE WHEN elapsed_time = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, split ORDER BY opos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS split_no FROM sp""")
def q_split_cycle_id(spark, sf):
    from ..operators import cycles
    from .registry import _cno
    d = cycles.split_label(_cno(spark, sf), "ts", SPLIT_AT)
    d = cycles.split_cycle_id(d, SI.SPEC, "split", "train")
    return d.filter(F.col("current_aeration") == 1).select("user_id", "event_id", "split", "split_no")


_FIELD_SQL = ", ".join(f'CAST({c} AS {"BIGINT" if f in ("weekday", "elapsed_time") else "DOUBLE"}) AS "{f}"' if c in ("weekday", "elapsed_time")
                       else f'round(CAST({c} AS DOUBLE), 6) AS "{f}"' for c, f in STEP_FIELDS.items())


@register("contract_fields", with_chain("steps") + f"SELECT event_id, {_FIELD_SQL} FROM steps WHERE current_aeration = 1")
def q_contract_fields(spark, sf):
    """The step model's 16 features from request fields that come as text."""
    from ..operators import clean
    d = steps(spark, sf).filter(F.col("current_aeration") == 1)
    fields = {"event_id": "event_id", **STEP_FIELDS}
    text = d.select(*[F.col(c).cast("string").alias(c) for c in fields], F.lit("x").alias("request_id"))
    out = clean.rename_to_contract(text, fields, ("event_id", "weekday", "elapsed_time"))
    return out.select("event_id", *[F.col(f"`{f}`") if f in ("weekday", "elapsed_time") else F.round(F.col(f"`{f}`"), 6).alias(f) for f in STEP_FIELDS.values()])
