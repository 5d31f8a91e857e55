"""Block-size invariance: the block-carry operators equal a plain per-key
computation (a plain loop over the survey's definitions)."""
from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cyclekit.operators import clean, cycles
from cyclekit.operators.series import SeriesSpec, with_position

T0 = datetime(2024, 1, 1)


def expected(rows: list[tuple]) -> dict[int, tuple]:
    """seq -> (run_id, rows of the run, elapsed, interpolated v), walking each key's rows in order."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        run, start, runs = 0, 0, []
        for i, r in enumerate(own):
            if i == 0 or r[3] != own[i - 1][3]:
                run, start = run + 1, i
            runs.append((run, start))
        known = [i for i, r in enumerate(own) if r[4] is not None]
        for i, r in enumerate(own):
            before = max((j for j in known if j <= i), default=None)
            after = min((j for j in known if j >= i), default=None)
            if before is None or after is None:
                near = before if after is None else after
                v = None if near is None else own[near][4]
            elif before == after:
                v = r[4]
            else:
                v = own[before][4] + (own[after][4] - own[before][4]) * (i - before) / (after - before)
            out[r[2]] = (runs[i][0], sum(x[0] == runs[i][0] for x in runs), (i - runs[i][1]) * 10 * r[3], v)
    return out


rows_st = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5000), st.sampled_from([0, 1]),
                             st.one_of(st.none(), st.floats(-50, 50, allow_nan=False))), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, block=st.integers(1, 9), bucket=st.sampled_from([60, 3600, 86400]))
def test_block_invariance(spark, rows, block, bucket):
    data = [(f"k{k}", T0 + timedelta(minutes=m), i, fl, v) for i, (k, m, fl, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, seq long, f int, v double")
    spec = SeriesSpec(("k",), ("ts", "seq"), bucket_seconds=bucket, block_rows=block)
    d = cycles.cycle_columns(with_position(df, spec), spec, flag="f")
    d = clean.interpolate_linear(d, spec, ["v"]).toPandas().sort_values("seq")
    want = expected(data)
    assert {r.seq: (r.run_id, r.run_rows, r.elapsed_time) for r in d.itertuples()} == {k: v[:3] for k, v in want.items()}
    np.testing.assert_allclose(d["v"].astype(float).to_numpy(), [float("nan") if want[q][3] is None else want[q][3] for q in d["seq"]],
                               rtol=1e-9, atol=1e-12, equal_nan=True)


def test_null_key_is_a_series(spark):
    rows = [(None, T0 + timedelta(minutes=i), i, i // 2 % 2, float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, f int, v double")
    spec = SeriesSpec(("k",), ("ts", "seq"), block_rows=2)
    got = cycles.cycle_columns(with_position(df, spec), spec, flag="f").orderBy("seq").collect()
    assert [r.run_id for r in got] == [1, 1, 2, 2, 3, 3, 4]


def test_hot_key_is_split_into_bounded_blocks(spark):
    """One key holds 90% of the rows: after numbering, every (key, block) window
    partition holds at most block_rows own rows plus the halo, and results still
    equal the per-key computation."""
    from pyspark.sql import functions as F

    from cyclekit.operators.series import BLK, OWN, with_halo
    n_hot, n_cold = 900, 100
    rows = [("hot", T0 + timedelta(minutes=i), i, int((i // 7) % 2), float(i % 13)) for i in range(n_hot)]
    rows += [(f"c{i % 5}", T0 + timedelta(minutes=i), n_hot + i, int((i // 3) % 2), None) for i in range(n_cold)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq long, f int, v double")
    spec = SeriesSpec(("k",), ("ts", "seq"), bucket_seconds=3600, block_rows=50)
    pos = with_position(df, spec)
    sizes = with_halo(pos, spec, before=6, after=2).groupBy("k", BLK).agg(
        F.sum(F.col(OWN).cast("int")).alias("own"), F.count(F.lit(1)).alias("all"))
    # (a block past a key's last one can receive up to ``before`` halo copies and no own rows)
    top = sizes.agg(F.max("own"), F.max("all"),
                    F.countDistinct(F.when((F.col("k") == "hot") & (F.col("own") > 0), F.col(BLK)))).first()
    assert top[0] <= 50 and top[1] <= 50 + 6 + 2 and top[2] == n_hot // 50
    d = cycles.cycle_columns(pos, spec, flag="f").toPandas().sort_values("seq")
    want = expected(rows)
    assert {r.seq: (r.run_id, r.elapsed_time) for r in d.itertuples()} == {k: (v[0], v[2]) for k, v in want.items()}
