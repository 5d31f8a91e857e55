"""Structured Streaming: live control signal (ST1-ST5, IO4).

Events: one stream with ``event_kind`` 'start' or 'tick', keyed by ``reactor``. The stateful
step (``ControlProcessor``) runs on lanes of reactors and holds typed state per reactor, bounded
whatever the history: the open cycle (start prediction, id) and its last ``WINDOW_SIZE`` ticks. It emits what only
state can give: the start prediction, the buffer's fill, the features of the run so far and
the window of scaled rows. Scoring and the control signal are columns after it, the same
``signal_columns`` as in the batch back-test, so a Spark ML step model scores the stream.

Events of one key inside a micro-batch are taken in event-time order; a source limit
(``maxFilesPerTrigger``) bounds a micro-batch."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.control import signal_columns
from ..schema import MIN_T_SIGNAL, SCALER_CLIP, STEP_MINUTES, WINDOW_SIZE

SENSOR_FIELDS = ["nh4", "no3", "ph", "temp", "current_r", "nh4_no3_ratio", "do_saturation", "nh4_diff",
                 "no3_diff", "ph_diff", "nh4_rolling_mean", "nh4_decay_rate", "hour_sin", "hour_cos"]

#: Features of the run so far, filled in when the client did not send them (ST5).
RUN_FEATURES = ["nh4_diff", "no3_diff", "ph_diff", "nh4_decay_rate", "nh4_rolling_mean"]

EVENT_SCHEMA = T.StructType([
    T.StructField("event_kind", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("reactor", T.StringType()),
    T.StructField("elapsed_time", T.IntegerType()),
    T.StructField("start_pred_raw", T.DoubleType()),
    *[T.StructField(c, T.DoubleType()) for c in SENSOR_FIELDS],
    T.StructField("weekday", T.IntegerType()),
])

#: One step of the window: the features of the step model, in order.
TICK_FIELDS = [*SENSOR_FIELDS, "weekday", "elapsed_time"]

#: Typed state of a reactor: the open cycle and its last ticks (oldest first; columns TICK_FIELDS and
#: the buffer's fill, as doubles row after row: a list of lists costs more than the step itself).
CYCLE_STATE = T.StructType([
    T.StructField("start_pred", T.IntegerType()),
    T.StructField("cycle_id", T.StringType()),
    T.StructField("ticks", T.BinaryType()),
])
REACTOR_KEY = T.StructType([T.StructField("reactor", T.StringType())])

#: Lanes that reactors are dealt to by hash. The stateful step runs once a lane and micro-batch, over
#: all of the lane's reactors at once: a call a reactor costs some ten milliseconds of Python and
#: socket time for a few rows.
LANES = 512

#: What the stateful step emits: one row an event, kind 'start', 'tick' or 'skipped'; ``x`` are
#: the tick's values in the order of TICK_FIELDS. Numbers that may be missing are doubles (NaN).
PACKED_SCHEMA = T.StructType([
    T.StructField("reactor", T.StringType()),
    T.StructField("event_kind", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("seq", T.LongType()),
    T.StructField("cycle_id", T.StringType()),
    T.StructField("start_pred", T.DoubleType()),
    T.StructField("buffer_fill", T.DoubleType()),
    T.StructField("x", T.ArrayType(T.DoubleType())),
    T.StructField("window", T.ArrayType(T.DoubleType())),
])

Scaler = dict[str, tuple[float, float]]


def cycle_id_for(reactor: str, start_time) -> str:
    """ST3: replay-safe cycle id (a hash of reactor and start time, not a random uuid)."""
    return hashlib.sha256(f"{reactor}|{start_time:%Y-%m-%d %H:%M:%S}".encode()).hexdigest()[:32]


def run_features_so_far(x: np.ndarray, first: np.ndarray, step: int = STEP_MINUTES) -> np.ndarray:
    """ST5: fill the run features that a client did not send, from the cycle's earlier ticks.
    ``x`` holds the ticks in order (columns TICK_FIELDS, NaN missing), ``first`` the place of
    each tick's cycle. Changes are 0 where either value is missing."""
    at = {c: i for i, c in enumerate(TICK_FIELDS)}
    here = np.arange(len(x))

    def back(c: str, k: int) -> np.ndarray:
        """The value ``k`` ticks before in the same cycle, NaN where there is none."""
        old = np.full(len(x), np.nan)
        some = here - k >= first
        old[some] = x[here[some] - k, at[c]]
        return old

    def fill(c: str, value: np.ndarray) -> None:
        x[:, at[c]] = np.where(np.isnan(x[:, at[c]]), value, x[:, at[c]])

    for c in ("nh4", "no3", "ph"):
        fill(f"{c}_diff", np.nan_to_num(x[:, at[c]] - back(c, 1), nan=0.0))
    fill("nh4_decay_rate", np.nan_to_num(x[:, at["nh4"]] - back("nh4", 3), nan=0.0) / (3 * step))
    recent = np.column_stack([back("nh4", k) for k in range(5, 0, -1)] + [x[:, at["nh4"]]])
    n = (~np.isnan(recent)).sum(axis=1)
    fill("nh4_rolling_mean", np.where(n > 0, np.nansum(recent, axis=1) / np.maximum(n, 1), np.nan))
    return x


def packed_events(events: DataFrame) -> DataFrame:
    """Events with their lane and their values in one array ``x`` (order of TICK_FIELDS, NaN missing)."""
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in TICK_FIELDS])
    lane = F.pmod(F.xxhash64("reactor"), F.lit(LANES)).cast("int").alias("lane")
    return events.select(lane, "reactor", "event_kind", "event_time", "seq", "start_pred_raw", x.alias("x"))


def advance_all(states: dict, batch: pd.DataFrame, scaler: Scaler | None = None) -> tuple[dict, pd.DataFrame]:
    """States by reactor (start prediction, cycle id, ticks as a matrix; None or missing: no state) and
    the packed events of any number of reactors -> the new states of those reactors and one
    output row an event (PACKED_SCHEMA).

    A start event opens a cycle (without a prediction its ticks are skipped, as are ticks
    without elapsed time and ticks before any start). The buffer restarts where elapsed
    falls."""
    who, names = pd.factorize(batch["reactor"], use_na_sentinel=False)
    names = [None if pd.isna(n) else n for n in names]
    start = (batch["event_kind"] == "start").to_numpy()
    time, seq = batch["event_time"].to_numpy(), batch["seq"].to_numpy()
    order = np.lexsort((~start, seq, time, who))
    who, start, time, seq = who[order], start[order], time[order], seq[order]
    raw = np.array(batch["x"].tolist(), dtype=float).reshape(-1, len(TICK_FIELDS))[order]
    # cycles of all reactors, each reactor's open one first: ``number`` of every event
    starts = np.bincount(who[start], minlength=len(names))
    opened = np.cumsum(starts + 1) - (starts + 1)
    number = np.cumsum(start) + who
    old_states = [states.get(n) or (None, None, None) for n in names]
    preds, ids = np.full(len(names) + int(start.sum()), np.nan), [None] * (len(names) + int(start.sum()))
    preds[opened] = [np.nan if s[0] is None else s[0] for s in old_states]
    pred = batch["start_pred_raw"].to_numpy(dtype=float, na_value=np.nan)[order][start]
    preds[number[start]] = np.trunc(np.clip(pred, MIN_T_SIGNAL, 2 ** 31 - 1))
    for c, s in zip(opened.tolist(), old_states):
        ids[c] = s[1]
    for c, r, t in zip(number[start].tolist(), who[start].tolist(), time[start]):
        ids[c] = cycle_id_for(names[r], pd.Timestamp(t))

    good = ~start & ~np.isnan(raw[:, -1]) & ~np.isnan(preds[number])
    none = np.empty((0, len(TICK_FIELDS) + 1))
    held = [none if s[2] is None else np.asarray(s[2], dtype=float).reshape(-1, len(TICK_FIELDS) + 1) for s in old_states]
    n_held = np.array([len(h) for h in held], dtype=int)
    ticks = np.concatenate([none, *held])
    of = np.concatenate([np.repeat(opened, n_held), number[good]])       # cycle of each tick
    by_cycle = np.argsort(of, kind="stable")                             # a cycle's old ticks first
    of, is_old = of[by_cycle], by_cycle < len(ticks)
    first = np.searchsorted(of, of, side="left")
    x = run_features_so_far(np.concatenate([ticks[:, :-1], raw[good]])[by_cycle], first)
    here = np.arange(len(x))
    falls = np.concatenate([[False], x[1:, -1] < x[:-1, -1]])[:len(x)]
    reset = ~is_old & ((here == first) | falls)
    since = np.maximum.accumulate(np.where(reset, here, -1)) if len(x) else here
    before, filled = np.zeros(len(preds), int), np.zeros(len(preds))     # old ticks of a cycle, the last one's fill
    before[opened], filled[opened] = n_held, [h[-1, -1] if len(h) else 0 for h in held]
    fill = np.where(since >= first, here - since + 1, filled[of] + here - (first + before[of] - 1))
    fill = np.minimum(fill, WINDOW_SIZE)
    fill[is_old] = ticks[:, -1]

    z = x
    if scaler:
        mean, std = (np.array([scaler.get(c, (0.0, 1.0))[k] for c in TICK_FIELDS]) for k in (0, 1))
        known = np.array([c in scaler for c in TICK_FIELDS])
        z = np.where(known, np.clip((x - mean) / std, -SCALER_CLIP, SCALER_CLIP), x)
    values, fills, place = np.full(raw.shape, np.nan), np.where(start, 0.0, np.nan), np.zeros(len(raw), int)
    place[good] = np.flatnonzero(~is_old)
    values[good], fills[good] = x[place[good]], fill[place[good]]
    values[start, -1] = 0.0
    out = pd.DataFrame({
        "reactor": np.array(names, dtype=object)[who], "event_kind": np.where(start, "start", np.where(good, "tick", "skipped")), "event_time": time,
        "seq": seq, "cycle_id": [ids[c] for c in number.tolist()], "start_pred": np.where(start | good, preds[number], np.nan), "buffer_fill": fills,
        "x": list(values),
        "window": [z[p - WINDOW_SIZE + 1:p + 1].ravel() if f == WINDOW_SIZE else None for p, f in zip(place.tolist(), fills.tolist())]})

    last, rest = opened + starts, np.column_stack([x, fill])
    ends = np.searchsorted(of, last, side="right").tolist()
    begins = np.searchsorted(of, last, side="left").tolist()
    after = {n: (None if np.isnan(preds[c]) else int(preds[c]), ids[c], rest[max(lo, hi - WINDOW_SIZE):hi])
             for n, c, lo, hi in zip(names, last.tolist(), begins, ends)}
    return after, out


def advance(reactor: str, state: tuple | None, batch: pd.DataFrame, scaler: Scaler | None = None) -> tuple[tuple, pd.DataFrame]:
    """``advance_all`` for one reactor."""
    after, out = advance_all({reactor: state}, batch.assign(reactor=reactor), scaler)
    pred, cycle_id, ticks = after.get(reactor, state)
    return (pred, cycle_id, ticks.tolist()), out


class ControlProcessor(StatefulProcessor):
    """ST1 per lane of reactors: typed state a reactor in, one row an event out. A reactor's state is
    an entry of its own, so a micro-batch reads and writes those of its own reactors alone."""

    def __init__(self, scaler: Scaler | None = None):
        self.scaler = scaler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cycles = handle.getMapState("cycles", REACTOR_KEY, CYCLE_STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = list(rows)                                    # one lane's events of a bounded micro-batch
        batch = batch[0] if len(batch) == 1 else pd.concat(batch, ignore_index=True)
        states = {}
        for r in batch["reactor"].unique():
            r = None if pd.isna(r) else r
            if (s := self.cycles.getValue((r,))) is not None:
                states[r] = (s[0], s[1], np.frombuffer(s[2]))
        after, out = advance_all(states, batch, self.scaler)
        for r, (pred, cycle_id, ticks) in after.items():
            self.cycles.updateValue((r,), (pred, cycle_id, ticks.tobytes()))
        yield out

    def close(self) -> None:
        pass


def use_typed_state(spark: SparkSession) -> None:
    """Typed state needs the RocksDB state store; set it before a query with state starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def standin_step_pred() -> Column:
    """Stand-in step prediction (same formula as the batch back-test): no prediction without
    the rolling mean."""
    return F.lit(3.0) * F.col("nh4_rolling_mean") - F.col("elapsed_time")


def control_steps(events: DataFrame, scaler: Scaler | None = None, dedupe_within: str | None = None) -> DataFrame:
    """ST1's stateful step alone: kind, cycle id, start prediction, elapsed time, buffer fill, all
    sensor values with the run features filled in, and ``window`` once the buffer is full."""
    use_typed_state(events.sparkSession)
    if dedupe_within:
        events = (events.withColumn("_at", F.col("event_time").cast("timestamp")).withWatermark("_at", dedupe_within)
                  .dropDuplicatesWithinWatermark(["reactor", "event_kind", "event_time", "elapsed_time"]))
    steps = packed_events(events).groupBy("lane").transformWithStateInPandas(ControlProcessor(scaler), PACKED_SCHEMA, "append", "none")
    value = {c: F.nanvl(F.get("x", F.lit(i)), F.lit(None)) for i, c in enumerate(TICK_FIELDS)}
    whole = {"weekday", "elapsed_time"}
    return steps.select("reactor", "event_kind", "event_time", "seq", "cycle_id", value["elapsed_time"].cast("int").alias("elapsed_time"),
                        *[F.nanvl(c, F.lit(None)).cast("int").alias(c) for c in ("start_pred", "buffer_fill")],
                        *[v.alias(c) for c, v in value.items() if c not in whole], value["weekday"].cast("int").alias("weekday"), "window")


def control_stream(events: DataFrame, step_pred: Column | Callable[[DataFrame], DataFrame] | None = None,
                   scaler: Scaler | None = None, dedupe_within: str | None = None) -> DataFrame:
    """ST1: keyed state per reactor, on a streaming DataFrame (the batch twin is
    ``operators.control.replay``); then scoring and the control signal as columns.

    ``step_pred`` is the step model: a column on the emitted row, or a function that adds the
    column ``step_pred`` (score a saved model on ``window``, say). The source system appends
    a repeated tick again (same elapsed); that is the default here. ``dedupe_within`` (a
    watermark delay such as "30 minutes", on a stream) drops repeated (reactor, kind, event
    time, elapsed) events first."""
    d = control_steps(events, scaler, dedupe_within)
    d = step_pred(d) if callable(step_pred) else d.withColumn("step_pred", standin_step_pred() if step_pred is None else step_pred)
    signal = ["mode", "t_signal", "was_clamped", "should_continue"]
    d = signal_columns(d, "start_pred", "elapsed_time", "buffer_fill", "step_pred")
    tick = F.col("event_kind") == "tick"
    return d.withColumns({c: F.when(tick, F.col(c)) for c in signal}).drop("base_remaining", "raw_signal", "step_pred", "window")


def validate_stream(events: DataFrame, reactors: list[str] | DataFrame | None = None,
                    required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """ST2: stateless checks; returns (valid, quarantine). A reactor must be named and, with
    ``reactors`` (a list, or a table with a column ``reactor``), be one of them. ``required``
    features must be there (those with bounds always must)."""
    from ..operators.clean import range_rules, validate_rows
    rules = range_rules(reactor_col=None, elapsed_col=None)
    known = F.lit(True)
    if isinstance(reactors, DataFrame):
        events = events.join(reactors.select("reactor", F.lit(True).alias("_known")).distinct(), "reactor", "left")
        known = F.coalesce("_known", F.lit(False))
    elif reactors:
        known = F.col("reactor").isin(*reactors)
    rules.append(("reactor_unknown", F.col("reactor").isNull() | ~known))
    tick = F.col("event_kind") == "tick"
    e = F.col("elapsed_time")
    rules.append(("elapsed_time_step", tick & (e.isNull() | (F.pmod(e, F.lit(STEP_MINUTES)) != 0))))
    rules += [(f"{c}_missing", F.col(c).isNull()) for c in required or []]
    v = validate_rows(events, rules).drop("_known")
    return v.filter("is_valid"), v.filter("NOT is_valid")


def audit_writer(path: str, reactor_col: str = "reactor", partition_by: tuple[str, ...] | None = None):
    """ST4/IO4: foreachBatch sink appending decisions and their sensor values to a partitioned
    Parquet table, idempotent on the batch id (a replayed batch is not written twice)."""
    from ..sources.sinks import append_audit
    parts = partition_by or (reactor_col, "date")

    def write(batch: DataFrame, batch_id: int) -> None:
        d = (batch.withColumn("request_id", F.sha2(F.concat_ws("|", F.col(reactor_col), F.col("seq").cast("string"),
                                                                F.col("event_kind")), 256))
                  .withColumn("timestamp", F.col("event_time"))
                  .withColumn("date", F.to_date("event_time")))
        append_audit(d, path, batch_id=batch_id, partition_by=parts)

    return write
