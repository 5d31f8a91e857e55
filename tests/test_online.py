"""Streams over several micro-batches, restart of the online chain, saved models, incremental build."""
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cyclekit.operators import models
from cyclekit.operators.artefacts import ModelStore, missing_features
from cyclekit.operators.series import POS, SeriesSpec
from cyclekit.plans import registry_more as R
from cyclekit.plans.build import BuildOptions, build_dataset
from cyclekit.plans.incremental import IncrementalBuild, build_slice
from cyclekit.schema import FeatureSpec
from cyclekit.streaming import control as ST
from cyclekit.streaming.online import append_slice, chain_tables, run_chain

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def rows_of(df, order):
    return df.toPandas().sort_values(order).reset_index(drop=True)


def test_control_stream_in_batches_equals_backtest(spark):
    """ST1 == C5 over three micro-batches, with the sensor values in the audit rows."""
    events = R.control_events(spark, SF)
    batches = []

    def transform(stream):
        return ST.control_stream(stream)

    out = R.run_stream(spark, events, transform, "batches")
    batches = [r[0] for r in out.select("batch_id").distinct().collect()]
    got = rows_of(out.filter("event_kind = 'tick'"), ["reactor", "seq"])
    want = R.replayed(spark, SF).withColumn("reactor", F.col("user_id").cast("string")).withColumnRenamed("event_id", "seq")
    want = rows_of(want, ["reactor", "seq"])
    assert len(batches) == R.SLICES and len(got) == len(want) > 0
    for c in ["elapsed_time", "start_pred", "buffer_fill", "mode", "t_signal", "was_clamped", "should_continue"]:
        assert list(got[c]) == list(want[c]), c
    for c in ["nh4", "temp", "do_saturation", "nh4_rolling_mean"]:
        assert got[c].sub(want[c]).abs().max() < 1e-9, c


def event(i, kind, elapsed, reactor="A", pred=None, **more):
    base = {c: 1.0 for c in ST.SENSOR_FIELDS} | {"hour_sin": 0.0, "hour_cos": 1.0}
    return {"event_kind": kind, "event_time": T0 + timedelta(minutes=10 * i), "seq": i, "reactor": reactor, "elapsed_time": elapsed,
            "start_pred_raw": pred, **base, "weekday": 0, **more}


def frame(spark, events):
    return spark.createDataFrame([[e[f.name] for f in ST.EVENT_SCHEMA.fields] for e in events], ST.EVENT_SCHEMA)


def test_chain_resumes_after_a_failed_batch(spark):
    """Stop after a write that was not committed: the batch is run again, its rows stand once, the
    open cycle goes on from state, rejected rows stand once in quarantine."""
    paths = R.chain_paths(spark, "test")
    first = [event(0, "start", 0, pred=100.0), *(event(i, "tick", 10 * (i - 1)) for i in range(1, 6)), event(6, "tick", 55), event(7, "tick", 60, nh4=-1.0),
             event(8, "tick", 60, reactor="Z"), event(9, "tick", 50, do_saturation=None)]
    later = [event(10, "tick", 50), event(11, "tick", 60), event(12, "tick", 70), event(13, "start", 0, pred=None), event(14, "tick", 0)]
    append_slice(frame(spark, first), paths.source, 1)
    assert run_chain(spark, paths, reactors=["A", "B"])[1] == 1
    append_slice(frame(spark, later), paths.source, 1)
    plain = ST.audit_writer(paths.audit, partition_by=("date",))

    def broken(batch, batch_id):
        plain(batch, batch_id)
        raise RuntimeError("power cut")

    with pytest.raises(Exception, match="power cut"):
        run_chain(spark, paths, reactors=["A", "B"], writer=broken)
    run_chain(spark, paths, reactors=["A", "B"])
    run_chain(spark, paths, reactors=["A", "B"])                 # nothing new: nothing written
    audit, rejected = chain_tables(spark, paths)
    got = rows_of(audit, ["seq", "event_kind"])
    assert list(zip(got.seq, got.event_kind)) == [(0, "start"), *((i, "tick") for i in range(1, 6)), (10, "tick"), (11, "tick"), (12, "tick"), (13, "start"), (14, "skipped")]
    ticks = got[got.event_kind == "tick"].set_index("seq")
    assert list(ticks.buffer_fill) == [1, 2, 3, 4, 5, 6, 7, 7] and list(ticks["mode"]) == ["xgb_only"] * 6 + ["integrated"] * 2
    assert list(ticks.t_signal) == [100, 90, 80, 70, 60, 50, 40, 30] and ticks.cycle_id.nunique() == 1
    bad = {r.seq: list(r.violations) for r in rejected.collect()}
    assert bad == {6: ["elapsed_time_step"], 7: ["nh4_range"], 8: ["reactor_unknown"], 9: ["do_saturation_missing"]} and rejected.count() == 4


def test_saved_step_model_scores_the_stream_as_the_batch(spark):
    """A fitted window model behind the stateful step: same predictions as on the back-test's windows."""
    saved, windows = R._step_model(spark, SF)
    want = rows_of(models.score_windows(saved.model, windows, "flat").select("user_id", "event_id", "pred"), ["event_id"])
    events = R.control_events(spark, SF)

    def transform(stream):
        steps = ST.control_steps(stream, scaler=saved.scaler)
        return models.score_windows(saved.model, steps.filter("event_kind = 'tick'"), "window").drop("window")

    got = rows_of(R.run_stream(spark, events, transform, "model").filter("buffer_fill = 7").select("seq", "pred"), ["seq"])
    assert list(got.seq) == list(want.event_id) and (got.pred - want.pred).abs().max() < 1e-4


def test_model_store_versions_and_contracts(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    train = spark.createDataFrame([(float(i), float(i % 3), float(2 * i)) for i in range(40)], "a double, b double, y double")
    spec = FeatureSpec("t", ("a", "b"), "y", frozenset({"y"}))
    model = models.fit_contract(train, spec, models.GBTParams(max_iter=5))
    with pytest.raises(FileNotFoundError):
        store.load("t")
    assert store.save("t", model, spec, {"a": (1.0, 2.0)}, {"test_from": "x"}) == 1 and store.save("t", model, spec) == 2
    (tmp_path / "models" / "t" / "v7").mkdir()                        # a version that was cut short
    assert store.versions("t") == [1, 2] and store.load("t").version == 2 and store.save("t", model, spec) == 8
    one = store.load("t", 1)
    assert one.spec == spec and one.scaler == {"a": (1.0, 2.0)} and one.split == {"test_from": "x"}
    a, b = (rows_of(models.score(m, train), ["a"]).pred for m in (model, one.model))
    assert list(a) == list(b)
    for bad in (FeatureSpec("t", ("a", "y"), "y", frozenset({"y"})), FeatureSpec("t", ("a", "a"), "y", frozenset()), FeatureSpec("t", ("a", "c"), "y", frozenset())):
        with pytest.raises(ValueError):
            models.fit_contract(train, bad)
    holes = spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (1.0, 2.0)], "a double, b double")
    assert tuple(missing_features(holes, ["a", "b"]).first()) == (3, 2)


SPEC = SeriesSpec(keys=("k",), order=("ts", "i"), block_rows=16)


def history(seed, n=260):
    """Awkward series: long runs, gaps, spikes, sentinels, a key that starts late, one that ends, a
    null key, a column that is missing for long."""
    import random
    r = random.Random(seed)
    rows, i = [], 0
    for key in ("a", "b", "late", "gone", None):
        on, t = False, T0
        for j in range(n if key in ("a", "b") else n // 3):
            on = on if r.random() < 0.93 else not on
            t += timedelta(minutes=10)
            at = t + timedelta(hours=30) if key == "late" else t
            hole = key == "a" and 60 < j < 150
            rows.append((key, at, i, r.choice([None, -999.0, r.random() * 9]) if r.random() < 0.3 else r.random() * 9,
                         None if hole or r.random() < 0.1 else r.choice([50.0, r.random() * 9]) if r.random() < 0.1 else r.random() * 9,
                         None if r.random() < 0.2 else 7.0 + r.random(), 15.0, 5.0 if on else 0.0))
            i += 1
    return rows


KIND = "k string, ts timestamp_ntz, i long, nh4 double, no3 double, ph double, temp double, current_r double"


@pytest.mark.parametrize("seed", [1, 2])
def test_incremental_build_equals_whole_build(spark, tmp_path, seed):
    import random
    rows = history(seed)
    want = rows_of(build_dataset(spark.createDataFrame(rows, KIND), SPEC), ["i"])
    r = random.Random(seed)
    cuts = sorted(T0 + timedelta(minutes=r.randint(1, 2600)) for _ in range(4))
    build = IncrementalBuild(spark, str(tmp_path / "inc"), SPEC)
    sizes = []
    for a, b in zip([T0, *cuts], [*cuts, T0 + timedelta(days=99)]):
        part = spark.createDataFrame([x for x in rows if a <= x[1] < b], KIND)
        build.add(part)
        sizes.append(build.state().count())
    assert max(sizes) < len(rows) // 2                      # open runs and gaps, not the history
    before = build.steps().count()
    build.close(part)
    assert before < len(rows) and build.state().count() == 0
    got = rows_of(build.steps(), ["i"])
    assert list(got.i) == list(want.i)
    for c in want.columns:
        if c != "_blk":
            pd.testing.assert_series_equal(got[c], want[c], check_dtype=False, check_names=False, rtol=1e-9, atol=1e-9, obj=c)


def test_incremental_build_refuses_late_rows_and_survives_a_failed_slice(spark, tmp_path):
    rows = history(3, 60)
    build = IncrementalBuild(spark, str(tmp_path / "inc"), SPEC)
    split = T0 + timedelta(minutes=300)
    head = spark.createDataFrame([x for x in rows if x[1] < split], KIND)
    tail = spark.createDataFrame([x for x in rows if x[1] >= split], KIND)
    build.add(head)
    with pytest.raises(ValueError, match="not later"):
        build.add(head.limit(3))
    assert build.slices() == 1
    build_slice(tail, build.state(), SPEC, BuildOptions())[0].write.parquet(str(tmp_path / "inc/steps/slice=1"))      # cut short: no manifest
    seen = build.steps().count()
    build.add(tail)
    build.close(tail)
    got, want = rows_of(build.steps(), ["i"]), rows_of(build_dataset(spark.createDataFrame(rows, KIND), SPEC), ["i"])
    assert seen < len(got) == len(want) and list(got.run_id) == list(want.run_id) and list(got[POS]) == list(want[POS])


def test_missing_month_file_is_an_error(spark, tmp_path):
    from cyclekit.sources.readers import read_months
    spark.range(3).write.parquet(str(tmp_path / "1"))
    with pytest.raises(FileNotFoundError):
        read_months(spark, {1: str(tmp_path / "1"), 2: str(tmp_path / "2")})


def test_contributions_and_monotone_scores_equal_brute_force(spark, tmp_path):
    from cyclekit.operators import explain
    import random
    r = random.Random(4)
    rows = [(i, r.random() * 9, r.random() * 3, r.random()) for i in range(300)]
    rows = [(*x, 5 * x[1] - 2 * x[2] + (30 if x[1] < 2 else 0) + r.random()) for x in rows]
    train = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    feats = ["a", "b", "c"]
    model = models.fit_model(train, feats, "y", models.GBTParams(max_iter=8, max_depth=3))
    nodes = explain.tree_nodes(model, str(tmp_path / "trees"))
    parts = {x.id: x for x in explain.contributions(train, nodes, feats, ["id"], 3).collect()}
    raw = {x.id: x.prediction for x in model.transform(train).select("id", "prediction").collect()}
    assert len(parts) == len(rows)
    for i, p in parts.items():
        assert abs(p.base + p.c_a + p.c_b + p.c_c - raw[i]) < 1e-8
    ranked = explain.contribution_importance(spark.createDataFrame(list(parts.values())), feats).orderBy("rank").collect()
    assert ranked[0].feature == "a" and [x["rank"] for x in ranked] == [1, 2, 3]

    some = train.filter("id < 40")
    got = {x.id: x.pred for x in explain.monotone_score(model, nodes, some, feats, "a", ["id"]).collect()}
    grid = [x / 20 for x in range(0, 181)]                      # finer than the split points that matter
    sweep = some.select("id", "b", "c", F.explode(F.array(*[F.lit(g) for g in grid])).alias("a"), F.col("a").alias("own"))
    want = {x.id: x.m for x in models.score(model, sweep.filter("a <= own")).groupBy("id").agg(F.max("pred").alias("m")).collect()}
    plain = {x.id: x.pred for x in models.score(model, some).collect()}
    for i, v in got.items():
        assert v >= plain[i] - 1e-9 and v >= want.get(i, 0.0) - 1e-9
    audit = models.monotone_audit(lambda d, k: explain.monotone_score(model, nodes, d, feats, "a", k), some, feats, ["a"], ["id"]).first()
    before = models.monotone_audit(model, some, feats, ["a"], ["id"]).first()
    assert audit.n_decreasing == 0 < before.n_decreasing and audit.n_points == before.n_points == 400


def test_metric_store_survives_a_failed_write(spark, tmp_path, monkeypatch):
    from cyclekit.schema import METRICS_SCHEMA
    from cyclekit.sources import sinks
    store = sinks.MetricStore(spark, str(tmp_path / "metrics"))
    assert store.version() == 0 and store.read().count() == 0
    kpi = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, None)], "site int, mae double, n double")
    assert store.upsert(sinks.metric_rows(kpi, "kpi", "2024-01-01 00:00:00", by=["site"])) == 1
    assert store.read().schema.names == METRICS_SCHEMA.names
    newer = sinks.metric_rows(kpi.filter("site = 0"), "kpi", "2024-01-02 00:00:00", ["mae"], ["site"]).withColumn("value", F.lit(9.0))

    def cut(*a, **k):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(store, "_at", lambda place, at=store._at: cut() if place.endswith(".json") else at(place))
        with pytest.raises(OSError):
            store.upsert(newer)                                  # the table is written, the version is not
    assert store.version() == 1 and {r.value for r in store.read().collect()} == {1.0, 2.0, 3.0, None}
    assert store.upsert(newer) == 2
    got = {(r.section, r.metric): r.value for r in store.read().collect()}
    assert got == {("kpi/site=0", "mae"): 9.0, ("kpi/site=0", "n"): 2.0, ("kpi/site=1", "mae"): 3.0, ("kpi/site=1", "n"): None}
    assert store.read(1).filter("value = 9").count() == 0


def test_model_replay_builds_the_step_table_once(spark, monkeypatch):
    """The start rows, the windows and the replay read one staged step table."""
    from cyclekit.plans import standin

    plain, built = standin.build_dataset, []
    monkeypatch.setattr(standin, "build_dataset", lambda *a, **k: built.append(k) or plain(*a, **k))
    rep, every = R.model_replay(spark, SF)
    assert len(built) == 1 and rep.count() > 0 and every.count() > 0


def test_periods_are_written_in_one_pass(spark):
    """IO2's stand-in files: one folder of periods a table, every row in its period."""
    quality, current = R.month_files(spark, SF)
    for paths in (quality, current):
        assert len({p.rsplit("/", 1)[0] for p in paths.values()}) == 1
        for k, path in paths.items():
            low, high = spark.read.parquet(path).selectExpr("cast(min(ts) as string)", "cast(max(ts) as string)").first()
            assert R.MONTH_FROM[k - 1] <= low <= high < R.MONTH_FROM[k]
    assert sum(spark.read.parquet(p).count() for p in quality.values()) == R.table(spark, SF, "events").count()
