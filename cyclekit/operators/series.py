"""Ordered series that stay parallel when one key holds most of the rows.

A *series* is every row of one key (``spec.keys``) in a total order
(``spec.order``: a timestamp first, then tie-breaks). Plain
``Window.partitionBy(key)`` would put a key's whole history into one task, and
the workload here has few keys with long histories. Every sequence operator in
this package is therefore built from four DataFrame steps:

1. ``with_position`` numbers rows ``1..n`` inside each key. Rows are ranked
   inside (key, time bucket) partitions and shifted by the row count of the
   earlier buckets, which comes from a small per-(key, bucket) count table
   (partial aggregation, then a running sum over that table).
2. Rows are grouped into fixed blocks of ``spec.block_rows`` consecutive
   positions (``_blk``). All later windows partition by (key, ``_blk``), so a
   task never sees more than one block plus a few halo rows.
3. ``with_halo`` copies the last/first few rows of each block into the
   neighbouring block, so ``lag``/``lead``/rolling frames see across edges.
4. ``block_scan`` carries running state (sums, last/next non-null value)
   across blocks via a per-(key, block) edge table: one row per block, i.e.
   ``rows / block_rows`` rows in total.

Results are identical to plain per-key windows for any block size.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
BLK = "_blk"
OWN = "_own"


@dataclass(frozen=True)
class SeriesSpec:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    bucket_seconds: int = 86_400
    block_rows: int = 65_536
    numbering: str = "time_bucket"  # lazy; "range" (sampled, writes a stage table) as an option

    def with_keys(self, *keys: str) -> "SeriesSpec":
        return replace(self, keys=tuple(keys))

    def with_block(self, block_rows: int) -> "SeriesSpec":
        return replace(self, block_rows=block_rows)


def _epoch_seconds(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    if isinstance(dt, T.TimestampType):
        return F.unix_seconds(c)
    if isinstance(dt, T.DateType):
        return F.datediff(c, F.lit("1970-01-01")).cast("long") * 86_400
    return c.cast("double")


def with_position(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``_pos`` (1-based row number in the key's order) and ``_blk``.

    A null key is a key like any other. The order must be total (add a tie-break
    column), otherwise positions are not reproducible across task retries.

    ``numbering="time_bucket"`` (default) ranks inside (key, time bucket) and adds the
    rows of the key's earlier buckets; it is one lazy plan and bounded by one bucket of
    one key (choose ``bucket_seconds`` for the densest key). ``numbering="range"``
    writes a stage table: range-partition on (keys, order) — Spark
    samples the data, so a hot key, a hot time bucket or a hot instant is split
    over balanced, ordered partitions — sort within partitions, take each row's
    index in its partition (``monotonically_increasing_id`` after the sort), and
    add the row counts of the key's earlier partitions from a (key, partition)
    count table."""
    if spec.numbering == "range":
        return _position_by_range(df, spec)
    keys = list(spec.keys)
    ts = spec.order[0]
    long_min = F.lit(-(2 ** 63)).cast("long")
    d = df.withColumn("_tb", F.coalesce(F.floor(_epoch_seconds(df, ts) / F.lit(spec.bucket_seconds)), long_min))
    counts = d.groupBy(*keys, "_tb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_tb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*keys, "_tb").orderBy(*[F.col(c).asc_nulls_first() for c in spec.order])
    d = d.withColumn("_lp", F.row_number().over(local))
    d = join_small(d, counts, keys + ["_tb"])
    pos = (F.col("_base") + F.col("_lp")).cast("long")
    return (d.withColumn(POS, pos)
             .withColumn(BLK, F.floor((F.col(POS) - 1) / F.lit(spec.block_rows)).cast("long"))
             .drop("_tb", "_lp", "_base"))


def _position_by_range(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    keys, order = list(spec.keys), list(spec.order)
    sort_cols = [F.col(c).asc_nulls_first() for c in keys + order]
    d = (df.repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
           .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)          # partition index of the id
    # The range bounds come from sampling, seeded per shuffle: the count table and
    # the rows must see the same partitioning, so the numbered rows are written
    # once (stage table in the shared checkpoint folder) and both read that.
    d = materialize(d.withColumn("_rp", part))
    counts = d.groupBy(*keys, "_rp").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.partitionBy(*keys).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_rp", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    d = join_small(d, counts, keys + ["_rp"])
    pos = (F.col("_base") + F.col("_mid") - F.col("_m0") + 1).cast("long")
    return (d.withColumn(POS, pos)
             .withColumn(BLK, F.floor((F.col(POS) - 1) / F.lit(spec.block_rows)).cast("long"))
             .drop("_mid", "_rp", "_m0", "_base"))


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys: a series whose key is null is a series."""
    names = {c: f"_on_{c}" for c in on}
    right = small.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[names[c]]) for c in on])
    return df.join(right, cond, how).drop(*names.values())


def ensure_position(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df if POS in df.columns else with_position(df, spec)


def block_window(spec: SeriesSpec, *extra: str) -> Window:
    return Window.partitionBy(*spec.keys, BLK, *extra).orderBy(POS)


def with_halo(df: DataFrame, spec: SeriesSpec, before: int = 0, after: int = 0) -> DataFrame:
    """Own rows (``_own`` true) plus copies of the last ``before`` rows of the
    previous block and the first ``after`` rows of the next block. One pass:
    each row is exploded into itself and at most two copies."""
    p = spec.block_rows
    i = F.col(POS) - 1                      # 0-based index in the key
    blk = F.col(BLK)
    copies = [F.struct(blk.alias(BLK), F.lit(True).alias(OWN))]
    # a row is copied into block b+j when it lies within ``before`` rows of that
    # block's first row (and into b-j when within ``after`` rows of its last);
    # with blocks larger than the halo only j = 1 can apply.
    for j in range(1, -(-before // p) + 1 if before else 1):
        start = (blk + j) * p
        copies.append(F.when(start - i <= before, F.struct((blk + j).alias(BLK), F.lit(False).alias(OWN))))
    for j in range(1, -(-after // p) + 1 if after else 1):
        end = (blk - j + 1) * p - 1
        copies.append(F.when((blk - j >= 0) & (i - end <= after),
                             F.struct((blk - j).alias(BLK), F.lit(False).alias(OWN))))
    arr = F.filter(F.array(*copies), lambda x: x.isNotNull())
    cols = [c for c in df.columns if c != BLK]
    return df.select(*cols, F.inline(arr))


def block_scan(df: DataFrame, spec: SeriesSpec, sums: dict[str, Column] | None = None,
               lasts: dict[str, Column] | None = None,
               nexts: dict[str, Column] | None = None) -> DataFrame:
    """Running state over the whole key, computed block-locally plus a carry.

    sums:  out = running sum of the column up to and including the row.
    lasts: out = struct(p, v) of the last non-null value at or before the row.
    nexts: out = struct(p, v) of the first non-null value at or after the row.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    keys = list(spec.keys)
    upto = block_window(spec).rowsBetween(Window.unboundedPreceding, 0)
    onward = block_window(spec).rowsBetween(0, Window.unboundedFollowing)

    def tagged(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(F.col(POS).alias("p"), c.alias("v")))

    def at(c: Column) -> Column:
        return F.when(c.isNotNull(), F.col(POS))

    # edge aggregates use fixed-width buffers (max/min of the position, max_by /
    # min_by of the value) so the partial aggregation is hash-based, not a sort
    local, edge_aggs, edge_structs = [], [], []
    for out, c in sums.items():
        local.append(F.sum(c).over(upto).alias(f"_ls_{out}"))
        edge_aggs.append(F.sum(c).alias(f"_es_{out}"))
    for out, c in lasts.items():
        local.append(F.max(tagged(c)).over(upto).alias(f"_ll_{out}"))
        edge_aggs += [F.max(at(c)).alias(f"_elp_{out}"), F.max_by(c, at(c)).alias(f"_elv_{out}")]
        edge_structs.append(F.when(F.col(f"_elp_{out}").isNotNull(), F.struct(
            F.col(f"_elp_{out}").alias("p"), F.col(f"_elv_{out}").alias("v"))))
    for out, c in nexts.items():
        local.append(F.min(tagged(c)).over(onward).alias(f"_ln_{out}"))
        edge_aggs += [F.min(at(c)).alias(f"_enp_{out}"), F.min_by(c, at(c)).alias(f"_env_{out}")]
        edge_structs.append(F.when(F.col(f"_enp_{out}").isNotNull(), F.struct(
            F.col(f"_enp_{out}").alias("p"), F.col(f"_env_{out}").alias("v"))))

    edge = df.groupBy(*keys, BLK).agg(*edge_aggs)
    prior = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(1, Window.unboundedFollowing)
    carry = [*keys, BLK]
    carry += [F.coalesce(F.sum(f"_es_{o}").over(prior), F.lit(0)).alias(f"_cs_{o}") for o in sums]
    carry += [F.max(e).over(prior).alias(f"_cl_{o}") for o, e in zip(lasts, edge_structs[:len(lasts)])]
    carry += [F.min(e).over(later).alias(f"_cn_{o}") for o, e in zip(nexts, edge_structs[len(lasts):])]
    edge = edge.select(*carry)

    finals = [(F.col(f"_ls_{o}") + F.col(f"_cs_{o}")).alias(o) for o in sums]
    finals += [F.coalesce(F.col(f"_ll_{o}"), F.col(f"_cl_{o}")).alias(o) for o in lasts]
    finals += [F.coalesce(F.col(f"_ln_{o}"), F.col(f"_cn_{o}")).alias(o) for o in nexts]
    kept = [c for c in df.columns if c not in set(sums) | set(lasts) | set(nexts)]
    return join_small(df.select("*", *local), edge, keys + [BLK]).select(*kept, *finals)


def key_totals(df: DataFrame, spec: SeriesSpec, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Whole-key aggregates attached to every row without moving a key's rows to
    one task: partial aggregates per (key, block), combined over the key's blocks
    by a window on the small edge table, joined back on (key, block).
    ``aggs``: out -> (kind, column), kind in {"max", "min", "sum"}."""
    keys = list(spec.keys)
    fn = {"max": F.max, "min": F.min, "sum": F.sum}
    edge = df.groupBy(*keys, BLK).agg(*[fn[k](c).alias(f"_kt_{o}") for o, (k, c) in aggs.items()])
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select(*keys, BLK, *[fn[k](f"_kt_{o}").over(whole).alias(o) for o, (k, _) in aggs.items()])
    return join_small(df, edge, keys + [BLK])


def run_boundaries(flag: str, spec: SeriesSpec, max_gap_seconds: int | None = None) -> dict[str, Column]:
    """Columns marking run starts (``_chg``) and run ends (``_last``); evaluate on
    a frame with at least one halo row on each side of every block. With
    ``max_gap_seconds`` a time gap larger than that also ends a run (by default
    runs count rows, not minutes)."""
    w = block_window(spec)
    f = F.col(flag)
    chg = (F.col(POS) == 1) | ~F.lag(f).over(w).eqNullSafe(f)
    last = F.lead(F.col(POS)).over(w).isNull() | ~F.lead(f).over(w).eqNullSafe(f)
    if max_gap_seconds is not None:
        t = F.col(spec.order[0])
        gap_before = F.timestamp_diff("SECOND", F.lag(t).over(w), t) > F.lit(max_gap_seconds)
        gap_after = F.timestamp_diff("SECOND", t, F.lead(t).over(w)) > F.lit(max_gap_seconds)
        chg = chg | F.coalesce(gap_before, F.lit(False))
        last = last | F.coalesce(gap_after, F.lit(False))
    return {"_chg": chg.cast("long"), "_last": last}


def run_scan(prefix: str = "run") -> tuple[dict, dict, dict]:
    """``block_scan`` arguments (sums, lasts, nexts) that finish a segmentation."""
    return ({f"{prefix}_id": F.col("_chg")},
            {"_rs": F.when(F.col("_chg") == 1, F.col(POS))},
            {"_re": F.when(F.col("_last"), F.col(POS))})


def run_finish(df: DataFrame, prefix: str = "run") -> DataFrame:
    return (df.withColumns({f"{prefix}_pos": F.col(POS) - F.col("_rs.p"),
                            f"{prefix}_rows": F.col("_re.p") - F.col("_rs.p") + 1})
              .drop("_rs", "_re", "_chg", "_last"))


def segment_runs(df: DataFrame, spec: SeriesSpec, flag: str, prefix: str = "run",
                 max_gap_seconds: int | None = None) -> DataFrame:
    """Gaps-and-islands over the whole key: a run is a maximal stretch of equal
    ``flag`` values (optionally also broken by time gaps > ``max_gap_seconds``).
    Adds ``{prefix}_id`` (first run = 1), ``{prefix}_pos`` (0-based position
    inside the run) and ``{prefix}_rows`` (run length)."""
    h = with_halo(df, spec, before=1, after=1)
    d = own_rows(h.withColumns(run_boundaries(flag, spec, max_gap_seconds)))
    sums, lasts, nexts = run_scan(prefix)
    return run_finish(block_scan(d, spec, sums=sums, lasts=lasts, nexts=nexts), prefix)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(OWN)


def materialize(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Cut lineage at a stage boundary: write the frame once as a Parquet table in
    a fresh folder under the shared ``spark.checkpoint.dir`` and read it back.

    The carry steps reference their input twice (rows + edge table), so long
    chains would otherwise grow the plan geometrically. The written table also
    bounds recomputation after executor loss, and later reads of it get column
    pruning and filter pushdown. (An eager ``Dataset.checkpoint()`` of an
    unpersisted plan would compute it twice: once to count, once to save.)"""
    if not enabled:
        return df
    import uuid

    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
