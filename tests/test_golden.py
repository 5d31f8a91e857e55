"""Hand-worked micro tables (FIXTURES.md section 3)."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cyclekit.operators import clean, control, cycles, features, metrics
from cyclekit.operators.series import SeriesSpec, with_position
from cyclekit.schema import SEPT_IMPUTE

T0 = datetime(2020, 9, 1, 0, 0)


def series(spark, values, col="v", key="A"):
    rows = [(key, T0 + timedelta(minutes=10 * i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k string, ts timestamp_ntz, seq long, {col} double")


def spec(block):
    return SeriesSpec(("k",), ("ts", "seq"), bucket_seconds=3600, block_rows=block)


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy("seq").select(*cols).collect()]


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_g_cycle(spark, block):
    d = series(spark, [0.0, 4.0, 4.0, 3.1, 3.0, None, 5.0], "cur")
    d = cycles.add_flag(d, "cur", 3.0)
    d = cycles.cycle_columns(d, spec(block))
    got = ordered(d, "current_aeration", "run_id", "cycle_runtime", "elapsed_time", "T_remaining")
    assert got == [(0, 1, 0, 0, 0), (1, 2, 30, 0, 30), (1, 2, 30, 10, 20), (1, 2, 30, 20, 10),
                   (0, 3, 0, 0, 0), (0, 3, 0, 0, 0), (1, 4, 10, 0, 10)]


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_g_feat(spark, block):
    rows = [("A", T0 + timedelta(minutes=10 * i), i, nh4, 1.0, 7.0, 1) for i, nh4 in enumerate([8.0, 7.0, 5.0, 2.0])]
    rows.append(("A", T0 + timedelta(minutes=40), 4, 9.0, 1.0, 7.0, 2))  # a new run restarts
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, nh4 double, no3 double, ph double, "
                                    "run_id long")
    s = spec(block)
    d = features.run_features(with_position(d, s), s)
    got = ordered(d, "nh4_diff", "nh4_decay_rate", "nh4_rolling_mean")
    exp = [(0.0, 0.0, 8.0), (-1.0, 0.0, 7.5), (-2.0, 0.0, 20 / 3), (-3.0, -0.2, 5.5), (0.0, 0.0, 9.0)]
    for g, e in zip(got, exp):
        assert g == pytest.approx(e)


@pytest.mark.parametrize("block", [1, 2, 4, 100])
def test_g_interp(spark, block):
    s = spec(block)
    d = with_position(series(spark, [None, 1.0, None, None, 4.0, None]), s)
    got = [r[0] for r in ordered(clean.interpolate_linear(d, s, ["v"]), "v")]
    assert got == pytest.approx([1, 1, 2, 3, 4, 4])


@pytest.mark.parametrize("block", [1, 3, 100])
def test_g_median(spark, block):
    s = spec(block)
    d = with_position(series(spark, [1.0, None, 3.0, 50.0, 5.0, None, 7.0]), s)
    got = [r[0] for r in ordered(clean.centered_stats(d, s, "v", 5), "_med")]
    assert got == pytest.approx([2, 3, 4, 5, 6, 7, 6])


def test_g_spike(spark):
    s = spec(2)
    d = with_position(series(spark, [5.0, 5.0, 21.0, 5.0, 5.0]), s)
    assert [r[0] for r in ordered(clean.despike(d, s, "v"), "v")] == [5, 5, None, 5, 5]
    d = with_position(series(spark, [5.0, 5.0, 19.0, 5.0, 5.0]), s)
    assert [r[0] for r in ordered(clean.despike(d, s, "v", k=5.0), "v")] == [5, 5, 19, 5, 5]
    assert [r[0] for r in ordered(clean.despike(d, s, "v", k=1.5), "v")] == [5, 5, None, 5, 5]


def test_g_ramp(spark):
    rows = [(datetime(2020, 9, 1, 5), 1.0, 1.0), (datetime(2020, 9, 30, 5), 30.0, 1.0), (datetime(2020, 10, 1), 9.0, 9.0)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, temp double, do_saturation double")
    got = clean.impute_ramp(d, "ts", SEPT_IMPUTE, month=9, span_days=29).orderBy("ts").collect()
    assert got[0]["temp"] == pytest.approx(23.87) and got[1]["temp"] == pytest.approx(21.33)
    assert got[2]["temp"] == 9.0 and got[0]["do_saturation"] == pytest.approx(8.437)


def test_g_signal(spark):
    rows = [(0, None, 1), (50, None, 6), (60, 100.0, 7), (100, 82.6, 7), (200, 33.4, 7), (210, 20.9, 7), (220, 4.0, 7)]
    d = spark.createDataFrame(rows, "elapsed_time int, step_pred double, buffer_fill int").withColumn(
        "start_pred", F.lit(181))
    got = [tuple(r) for r in control.signal_columns(d).orderBy("elapsed_time").select(
        "mode", "t_signal", "was_clamped", "should_continue").collect()]
    assert got == [("xgb_only", 181, False, True), ("xgb_only", 131, False, True), ("integrated", 121, False, True),
                   ("integrated", 82, False, True), ("integrated", 33, False, True),
                   ("integrated", 20, False, False), ("integrated", 10, True, False)]
    f = spark.createDataFrame([(3.2,), (300.0,)], "p double").select(
        control.start_floor("p").alias("s")) if hasattr(control, "start_floor") else None
    from cyclekit.functions.scalar import clamp_signal, start_floor, was_clamped
    f = spark.createDataFrame([(3.2,), (300.0,)], "p double").select(
        start_floor("p").alias("s"), clamp_signal("p").alias("c"), was_clamped("p").alias("w")).collect()
    assert [tuple(r) for r in f] == [(10, 10, True), (300, 250, True)]


def test_buffer_restart(spark):
    # elapsed 70 then 0 inside one cycle: the buffer restarts
    el = [0, 10, 20, 30, 40, 50, 60, 70, 0, 10, 20, 30, 40, 50, 60]
    rows = [("A", T0 + timedelta(minutes=10 * i), i, e, 1) for i, e in enumerate(el)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, elapsed_time int, cycle_no long")
    s = spec(4)
    b = control.buffer_state(with_position(d, s), s, cycle="cycle_no")
    b = b.withColumn("start_pred", F.lit(100)).withColumn("step_pred", F.lit(0.0))
    got = ordered(control.signal_columns(b), "buffer_fill", "mode")
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7, 7, 1, 2, 3, 4, 5, 6, 7]
    assert got[7][1] == "integrated" and got[14][1] == "integrated" and got[13][1] == "xgb_only"


def test_g_kpi(spark):
    d = spark.createDataFrame([(60, 30, 6.0), (40, 30, 1.0), (50, 60, 5.0), (80, None, None)],
                              "actual_runtime int, stop_elapsed int, stop_nh4 double")
    k = metrics.stop_kpis(d).first()
    assert k["no_stop_rate"] == pytest.approx(0.25) and k["avg_time_saved"] == pytest.approx(10)
    assert k["unsafe_early_stop_rate"] == pytest.approx(1 / 3) and k["avg_overrun"] == pytest.approx(10 / 3)
    assert k["nh4_risk_rate"] == pytest.approx(1 / 3)
    e = metrics.energy_savings(d).first()
    assert e["saved_min"] == pytest.approx(30) and e["sim_stop_avg_min"] == pytest.approx(50)


def test_g_stage(spark):
    d = spark.createDataFrame([(0, 10, 20), (30, 10, 40), (40, 10, 15), (90, 10, 10), (100, 50, 20)],
                              "elapsed int, pred int, truth int")
    st = {r["stage"]: r["mae"] for r in metrics.stage_metrics(d, "pred", "truth", "elapsed").collect()}
    assert st == {"0~30": pytest.approx(20), "31~90": pytest.approx(2.5), "91+": pytest.approx(30)}
    u = metrics.underprediction_rate(d, "pred", "truth").first()[0]
    assert u == pytest.approx(0.2)


def test_validate_rows(spark):
    d = spark.createDataFrame([(5.0, 120.0, 7.0, 20.0, 1.0, 0.5, 0.5, 3, 15, "반응조A"),
                               (5.0, 1.0, 7.0, 20.0, 1.0, 0.5, 0.5, 3, 20, "반응조A")],
                              "nh4 double, no3 double, ph double, temp double, current_r double, hour_sin double, "
                              "hour_cos double, weekday int, elapsed_time int, reactor string")
    v = clean.validate_rows(d, clean.range_rules()).collect()
    assert v[0]["violations"] == ["no3_range", "elapsed_time_step"] and not v[0]["is_valid"]
    assert v[1]["is_valid"]


def test_feature_contract():
    from cyclekit.schema import CYCLE_SPEC, STEP_SPEC, FeatureSpec
    assert CYCLE_SPEC.violations() == [] and STEP_SPEC.violations() == []
    bad = FeatureSpec("x", ("a", "a", "cycle_runtime"), "t", frozenset({"cycle_runtime"}), (1, 0))
    assert len(bad.violations()) == 3
    with pytest.raises(ValueError):
        bad.assert_valid()


def test_csv_header_and_charset(spark, tmp_path):
    """IO1: files with and without header, cp949 and UTF-8, both time formats and
    a bad timestamp (FIXTURES variants)."""
    from cyclekit.functions.scalar import parse_ts
    from cyclekit.schema import QUALITY_HEADER, QUALITY_SCHEMA
    from cyclekit.sources.readers import read_sensor_csv, read_sensor_csv_any_charset
    body = [["반응조 A", "12월01월20 0:10", "5.5", "", "3.0", "7.1", "18.0"],
            ["반응조 B", "2020-12-01 00:20:00", "-999", "", "2.0", "7.0", "18.5"],
            ["반응조 A", "not a time", "4.0", "", "1.0", "6.9", "18.1"]]
    hdr = ",".join(QUALITY_HEADER[:7])
    lines = [",".join(r) for r in body]
    (tmp_path / "u8").mkdir()
    (tmp_path / "u8" / "with_header.csv").write_text(hdr + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "u8" / "no_header.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "cp").mkdir()
    (tmp_path / "cp" / "legacy.csv").write_bytes((hdr + "\n" + "\n".join(lines) + "\n").encode("cp949"))
    d = read_sensor_csv(spark, [str(tmp_path / "u8")], QUALITY_SCHEMA, "계측기명")
    assert d.count() == 6 and d.filter(F.col("nh4") == -999).count() == 2
    p = d.select(parse_ts("수집시간").alias("t")).groupBy(F.col("t").isNull().alias("bad")).count().collect()
    assert {r["bad"]: r["count"] for r in p} == {False: 4, True: 2}
    c = read_sensor_csv_any_charset(spark, [str(tmp_path / "cp" / "legacy.csv")], QUALITY_SCHEMA, "계측기명")
    rows = c.orderBy("nh4").collect()
    assert [r["계측기명"] for r in rows] == ["반응조 B", "반응조 A", "반응조 A"] and rows[2]["nh4"] == 5.5


def test_max_gap_breaks_runs(spark):
    """G12 option: a gap longer than max_gap ends a run; by default runs count rows."""
    from cyclekit.operators.series import segment_runs
    mins = [0, 10, 20, 90, 100]
    rows = [("A", T0 + timedelta(minutes=m), i, 1) for i, m in enumerate(mins)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, f int")
    s = spec(2)
    plain = [r[0] for r in ordered(segment_runs(with_position(d, s), s, "f"), "run_id")]
    gapped = [r[0] for r in ordered(segment_runs(with_position(d, s), s, "f", max_gap_seconds=1800), "run_id")]
    assert plain == [1, 1, 1, 1, 1] and gapped == [1, 1, 1, 2, 2]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_carry_start(spark, block):
    """Values set on a cycle's start row reach every row of that cycle; a cycle
    whose start row has no value gets nulls (it does not inherit the previous one)."""
    cyc = [1, 1, 1, 2, 2, 3, 3, 3]
    val = [50.0, None, None, None, None, 70.0, None, None]
    rows = [("A", T0 + timedelta(minutes=10 * i), i, c, v) for i, (c, v) in enumerate(zip(cyc, val))]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, cycle_no long, sp double")
    s = spec(block)
    got = [r[0] for r in ordered(control.carry_start(with_position(d, s), s, "cycle_no", ["sp"]), "sp")]
    assert got == [50.0, 50.0, 50.0, None, None, 70.0, 70.0, 70.0]


@pytest.mark.parametrize("dedupe", [False, True])
def test_repeated_tick(spark, dedupe):
    """A repeated tick is appended again by default; ``dedupe_repeats`` drops it."""
    el = [0, 10, 10, 20]
    rows = [("A", T0 + timedelta(minutes=10 * i), i, e, 1, 40, 5.0, 1.0) for i, e in enumerate(el)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, elapsed_time int, "
                                    "current_aeration int, cycle_runtime int, nh4 double, p double")
    starts = d.filter("elapsed_time = 0").withColumn("start_pred_raw", F.lit(100.0))
    r = control.replay(d, starts, spec(2), "start_pred_raw", F.lit(0.0), checkpoint=False, dedupe_repeats=dedupe)
    got = [row[0] for row in ordered(r, "buffer_fill")]
    assert got == ([1, 2, 3] if dedupe else [1, 2, 3, 4])


def test_csv_columns_follow_the_header(spark, tmp_path):
    """IO1: named columns in any order, the header cell in any place, narrow files, NaN text;
    surplus cells are an error."""
    from cyclekit.schema import QUALITY_SCHEMA
    from cyclekit.sources.readers import read_sensor_csv, read_sensor_csv_any_charset
    files = {"a.csv": "계측기명,수집시간,ph,nh4\nA,t,7.1,5.5\n", "b.csv": "수집시간,계측기명,nh4,extra\nt,B,NaN,zz\n",
             "c.csv": "C,t,4.5\n", "d.csv": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    want = {("A", "t", 5.5, 7.1, None), ("B", "t", None, None, None), ("C", "t", 4.5, None, None)}
    cols = ["계측기명", "수집시간", "nh4", "ph", "no3"]
    assert {tuple(r) for r in read_sensor_csv(spark, [str(tmp_path)], QUALITY_SCHEMA, "계측기명").select(*cols).collect()} == want
    legacy = [str(tmp_path / "l.csv"), str(tmp_path / "m.csv")]
    (tmp_path / "l.csv").write_bytes(files["a.csv"].encode("cp949"))
    (tmp_path / "m.csv").write_bytes(files["b.csv"].encode("cp949"))
    got = read_sensor_csv_any_charset(spark, legacy, QUALITY_SCHEMA, "계측기명").select(*cols).collect()
    assert {tuple(r) for r in got} == want - {("C", "t", 4.5, None, None)}
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "w.csv").write_text("계측기명,nh4\nA,1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception):
        read_sensor_csv(spark, [str(tmp_path / "wide")], QUALITY_SCHEMA, "계측기명").collect()


def test_missing_prediction_is_no_signal(spark):
    """Null and NaN predictions stay null; their cycles are skipped and counted."""
    from cyclekit.functions.scalar import clip_nonneg, start_floor
    d = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (float("inf"),)], "p double")
    got = d.select(start_floor("p").alias("s"), clip_nonneg("p").alias("c")).collect()
    assert [r.s for r in got] == [None, None, 10, 2 ** 31 - 1] and [r.c for r in got][:3] == [None, None, 3.0]
    counts = control.skipped_cycles(d, "p").first()
    assert (counts.n_replayed, counts.n_skipped) == (2, 2)


def packed(events):
    """Events as the stateful step gets them."""
    import pandas as pd

    from cyclekit.streaming.control import TICK_FIELDS
    x = [[float("nan") if e.get(c) is None else float(e[c]) for c in TICK_FIELDS] for e in events]
    return pd.DataFrame([{**{c: e.get(c) for c in ("reactor", "event_kind", "event_time", "seq")}, "x": v,
                          "start_pred_raw": float("nan") if e["start_pred_raw"] is None else e["start_pred_raw"]} for e, v in zip(events, x)])


def test_stream_survives_missing_values():
    """ST1/ST5: missing sensors, a tick without elapsed time, a start without a prediction."""
    from cyclekit.streaming.control import SENSOR_FIELDS, TICK_FIELDS, advance

    def event(i, kind, elapsed, pred, nh4):
        return {**dict.fromkeys(SENSOR_FIELDS), "event_kind": kind, "event_time": T0 + timedelta(minutes=i), "seq": i, "reactor": "A",
                "elapsed_time": elapsed, "start_pred_raw": pred, "nh4": nh4, "weekday": 0}

    first = [event(0, "start", 0, 50.0, 1.0), event(1, "tick", 0, None, None), event(2, "tick", None, None, 2.0), event(3, "tick", 10, None, 3.0)]
    second = [event(4, "tick", 20, None, 4.0), event(5, "start", 0, None, 1.0), event(6, "tick", 0, None, 1.0)]
    state, rows = None, []
    for part in (first, second):
        state, out = advance("A", state, packed(part))
        rows += out.to_dict("records")
    assert [r["event_kind"] for r in rows] == ["start", "tick", "skipped", "tick", "tick", "start", "skipped"]
    assert [(r["start_pred"], r["x"][-1], r["buffer_fill"]) for r in rows if r["event_kind"] == "tick"] == [(50, 0, 1), (50, 10, 2), (50, 20, 3)]
    assert [r["x"][TICK_FIELDS.index("nh4_diff")] for r in rows if r["event_kind"] == "tick"] == [0.0, 0.0, 1.0]
    assert state[0] is None and state[2] == []


def test_stream_state_is_split_invariant():
    """ST1: any cutting of a reactor's events into micro-batches emits the same rows; the state
    never holds more than a window."""
    import random

    import numpy as np
    import pandas as pd

    from cyclekit.schema import WINDOW_SIZE
    from cyclekit.streaming.control import SENSOR_FIELDS, advance

    r = random.Random(6)
    events, elapsed = [], 0
    for i in range(120):
        kind = "start" if r.random() < 0.04 else "tick"
        elapsed = 0 if kind == "start" or r.random() < 0.02 else elapsed + 10
        events.append({**dict.fromkeys(SENSOR_FIELDS), "event_kind": kind, "event_time": T0 + timedelta(minutes=i), "seq": i,
                       "elapsed_time": None if r.random() < 0.05 else elapsed, "start_pred_raw": r.choice([None, 3.0, 90.5, 120.0]),
                       "weekday": 1, **{c: None if r.random() < 0.1 else r.random() * 9 for c in ("nh4", "no3", "ph")}})

    def run(cuts):
        state, out = None, []
        for a, b in zip([0, *cuts], [*cuts, len(events)]):
            if a < b:
                state, rows = advance("A", state, packed(events[a:b]), {"nh4": (3.0, 2.0)})
                assert len(state[2]) <= WINDOW_SIZE
                out.append(rows)
        return pd.concat(out, ignore_index=True)

    whole = run([])
    assert (whole["window"].notna()).sum() > 5 and set(whole["event_kind"]) == {"start", "tick", "skipped"}
    for _ in range(20):
        part = run(sorted(r.sample(range(1, 120), r.randint(1, 30))))
        for c in whole.columns:
            for x, y in zip(whole[c], part[c]):
                if isinstance(x, np.ndarray) or isinstance(y, np.ndarray):
                    assert np.array_equal(x, y, equal_nan=True), c
                else:
                    assert pd.isna(x) and pd.isna(y) or x == y, c


def test_audit_batch_replaces_itself(spark, tmp_path):
    """IO4: a replayed batch, also one that was cut short, leaves its rows once."""
    from cyclekit.sources.sinks import append_audit
    d = spark.createDataFrame([(i, T0 + timedelta(days=i % 2)) for i in range(10)], "seq long, timestamp timestamp_ntz")
    path = str(tmp_path / "audit")
    append_audit(d.limit(4), path, batch_id=3, partition_by=("date",))
    append_audit(d, path, batch_id=3, partition_by=("date",))
    append_audit(d, path, batch_id=4, partition_by=("date",))
    assert {r["batch_id"]: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()} == {3: 10, 4: 10}


def test_stream_lanes_equal_single_reactors(spark):
    """ST1: a lane's reactors in one call give what a call a reactor gives, over several
    micro-batches and with a null reactor; lanes, not reactors, bound the number of calls."""
    import random

    import numpy as np
    import pandas as pd

    from cyclekit.streaming.control import LANES, SENSOR_FIELDS, WINDOW_SIZE, advance, advance_all, packed_events

    r, names = random.Random(8), ["A", "B", "C", None]
    events = []
    for n in names:
        elapsed = 0
        for i in range(60):
            kind = "start" if r.random() < 0.06 else "tick"
            elapsed = 0 if kind == "start" or r.random() < 0.03 else elapsed + 10
            events.append({**dict.fromkeys(SENSOR_FIELDS), "event_kind": kind, "event_time": T0 + timedelta(minutes=i), "seq": i, "reactor": n,
                           "elapsed_time": None if r.random() < 0.05 else elapsed, "start_pred_raw": r.choice([None, 90.5, 120.0]),
                           "weekday": 1, **{c: None if r.random() < 0.1 else r.random() * 9 for c in ("nh4", "no3", "ph")}})
    states, alone = {}, dict.fromkeys(names)
    for lo, hi, who in ((0, 20, names), (20, 40, ["A", None]), (40, 60, names)):
        part = [e for e in events if lo <= e["seq"] < hi and e["reactor"] in who]
        after, out = advance_all(states, packed(r.sample(part, len(part))), {"nh4": (3.0, 2.0)})
        assert set(after) == set(who)
        states |= after
        for n in who:
            alone[n], want = advance(n, alone[n], packed([e for e in part if e["reactor"] == n]), {"nh4": (3.0, 2.0)})
            got = out[out["reactor"].isna() if n is None else out["reactor"] == n].reset_index(drop=True)
            assert list(states[n][:2]) == list(alone[n][:2]) and states[n][2].tolist() == alone[n][2] or np.array_equal(
                states[n][2], np.array(alone[n][2]), equal_nan=True)
            assert len(got) == len(want) and len(states[n][2]) <= WINDOW_SIZE
            for c in set(want.columns) - {"reactor"}:
                for x, y in zip(got[c], want[c]):
                    assert np.array_equal(x, y, equal_nan=True) if isinstance(y, np.ndarray) else pd.isna(x) and pd.isna(y) or x == y, c
    wide = spark.range(4 * LANES).selectExpr("cast(id as string) reactor", "'tick' event_kind", "timestamp_ntz'2024-01-01 00:00:00' event_time",
                                             "id seq", "0D start_pred_raw", "0 elapsed_time", "0 weekday", *[f"0D {c}" for c in SENSOR_FIELDS])
    assert packed_events(wide).select("lane").distinct().count() <= LANES
