"""Incremental feature build: a new slice of rows (a month's files) from those rows and a
small state alone, with the results of a build over the whole history.

A row's features are final once nothing later can change them: its despike window is full,
every interpolated column has a value at or behind it, and its run has ended. Per key the
*cut* is the first position that is not final. The state keeps the rows from a little
before the cut on (from the start of the cut's run, and two rows more for the despike
window), with their positions, run numbers and settled no3 values, and the last known
value of each interpolated column before them. So the state holds open runs and open gaps, not the
history; a series without any value yet in a column is kept whole, since the first
value to come fills it.

A slice's final rows and the new state are written first, then a manifest file that makes
both visible: a slice that failed midway leaves the state of the slice before."""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null
from ..operators.series import BLK, POS, SeriesSpec, join_small, materialize, with_position
from ..schema import NO3_SPIKE_WINDOW
from .build import BuildOptions, despiked, featured, flagged, scanned, segmented

HALF = NO3_SPIKE_WINDOW // 2
KEPT = {"_pos0": "long", "_run0": "long", "_no3_done": "double", "_settled": "boolean", "_out": "boolean"}


def _carried(o: BuildOptions) -> dict[str, str]:
    """State columns and their types: per row, and (on a key's first row) the last known values."""
    return KEPT | {f"_{k}_{c}": t for c in o.interp_cols for k, t in (("pp", "long"), ("pv", "double"))}


def build_slice(rows: DataFrame, state: DataFrame | None, spec: SeriesSpec, o: BuildOptions = BuildOptions(),
                close: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows``: the slice's aligned rows (columns as for ``build_dataset``); ``state``: the second
    table that the slice before gave, or None. Gives (the rows that have become final, with
    all columns of the step table and their positions; the new state). With ``close`` every
    row is final and the state is empty. Rows must be later than all earlier ones of
    their key (ValueError with their number otherwise)."""
    keys, kinds = list(spec.keys), _carried(o)
    plain = rows.columns
    new = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    if state is not None:
        last = state.groupBy(*keys).agg(F.max(F.struct(*spec.order)).alias("_last"))
        late = join_small(rows, last, keys).filter(F.struct(*spec.order) <= F.col("_last")).count()
        if late:
            raise ValueError(f"{late} rows are not later than the rows of earlier slices")
        new = state.select(*plain, *kinds).unionByName(new)
    d = materialize(new)
    prior = d.groupBy(*keys).agg(
        F.coalesce(F.min("_pos0") - 1, F.lit(0)).alias("_base"), F.coalesce(F.min("_run0") - 1, F.lit(0)).alias("_run_base"),
        *[F.max(f"_{k}_{c}").alias(f"_b{k}_{c}") for c in o.interp_cols for k in ("pp", "pv")])

    # positions and run numbers go on from the state's; settled no3 values stand
    d = join_small(with_position(d.drop(*[f"_{k}_{c}" for c in o.interp_cols for k in ("pp", "pv")]), spec), prior, keys)
    d = d.withColumn(POS, F.col(POS) + F.col("_base")).withColumn(BLK, F.floor((F.col(POS) - 1) / F.lit(spec.block_rows)).cast("long"))
    d = flagged(d, o).withColumn("_no3_raw", F.col("no3"))
    d = despiked(d, spec, o)
    d = d.withColumn("no3", F.when(F.coalesce("_settled", F.lit(False)), F.col("_no3_done")).otherwise(F.col("no3")))
    d = d.withColumns({f"_known_{c}": F.col(c) for c in o.interp_cols})
    d = scanned(d, spec, o).withColumn("run_id", F.col("run_id") + F.col("_run_base"))
    d = d.withColumns({f"_ip_{c}": F.coalesce(F.col(f"_ip_{c}"), F.when(F.col(f"_bpp_{c}").isNotNull(), F.struct(
        F.col(f"_bpp_{c}").alias("p"), F.col(f"_bpv_{c}").alias("v")))) for c in o.interp_cols})
    d = materialize(segmented(d, o))            # read for the cut, the final rows and the state

    # the cut of each key: the first row that something later can still change
    end = d.groupBy(*keys).agg(
        F.max(POS).alias("_n"), F.max(F.col(POS) - F.col("run_pos")).alias("_open"),
        *[F.max(F.when(F.col(f"_known_{c}").isNotNull(), F.col(POS))).alias(f"_any_{c}") for c in o.interp_cols if c != "no3"],
        *[F.max(f"_bpp_{c}").alias(f"_was_{c}") for c in o.interp_cols])
    settled = join_small(d, end.select(*keys, "_n"), keys).filter((F.col(POS) <= F.col("_n") - HALF) & F.col("_known_no3").isNotNull()).groupBy(
        *keys).agg(F.max(POS).alias("_any_no3")) if "no3" in o.interp_cols else None
    if settled is not None:
        end = join_small(end, settled, keys, "left")
    known = [F.coalesce(f"_any_{c}", f"_was_{c}", F.lit(0)) + 1 for c in o.interp_cols]
    cut = F.least("_open", F.greatest(F.col("_n") - HALF + 1, F.lit(1)), *known)
    end = end.select(*keys, "_n", (F.lit(None).cast("long") if close else cut).alias("_cut"))
    # a state row is kept from the start of the cut's run, and the despike window's rows before it
    d = join_small(d, end, keys)
    start = d.filter(F.col(POS) == F.col("_cut")).select(*keys, (F.col(POS) - F.col("run_pos") - HALF).alias("_from"))
    d = join_small(d, start, keys, "left")

    final = d.filter((F.col("_cut").isNull() | (F.col(POS) < F.col("_cut"))))
    carried = [c for c in d.columns if c.startswith(("_known_", "_bpp_", "_bpv_")) or c in (*KEPT, "_base", "_run_base", "_no3_raw", "_n", "_cut", "_from")]
    done = featured(d, spec, o).filter((F.col("_cut").isNull() | (F.col(POS) < F.col("_cut"))) & ~F.coalesce("_out", F.lit(False)))
    done = done.drop(*[c for c in carried if c in done.columns])

    kept = d.filter(F.col(POS) >= F.col("_from"))
    before = final.filter(F.col(POS) < F.col("_from")).groupBy(*keys).agg(*[
        a for c in o.interp_cols for at in [F.when(F.col(f"_known_{c}").isNotNull(), F.col(POS))]
        for a in (F.max(at).alias(f"_np_{c}"), F.max_by(f"_known_{c}", at).alias(f"_nv_{c}"))])
    kept = join_small(kept, before, keys, "left")
    first = F.col(POS) == F.greatest(F.col("_from"), F.col("_base") + 1)
    values = {c: F.col(c) for c in plain} | {c: F.col(f"_known_{c}") for c in o.interp_cols if c != "no3"} | {"no3": F.col("_no3_raw")}
    values |= {"_pos0": F.col(POS), "_run0": F.col("run_id"), "_no3_done": F.col("_known_no3") if "no3" in o.interp_cols else F.col("no3"),
               "_settled": F.col(POS) <= F.col("_n") - HALF, "_out": F.col(POS) < F.col("_cut")}
    for c in o.interp_cols:
        values[f"_pp_{c}"] = F.when(first, F.coalesce(f"_np_{c}", f"_bpp_{c}"))
        values[f"_pv_{c}"] = F.when(first, F.when(F.col(f"_np_{c}").isNotNull(), F.col(f"_nv_{c}")).otherwise(F.col(f"_bpv_{c}")))
    return done, kept.select(*[values[c].cast(kinds[c]).alias(c) if c in kinds else values[c].alias(c) for c in [*plain, *kinds]])


@dataclass(frozen=True)
class IncrementalBuild:
    """The growing step table under ``path`` (shared storage): ``steps/slice=k``, ``state/slice=k``
    and a manifest ``slices/k.json`` that makes slice k visible."""
    spark: SparkSession
    path: str
    spec: SeriesSpec
    options: BuildOptions = BuildOptions()

    def _folder(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def slices(self) -> int:
        """Number of the visible slices."""
        fs, p = self._folder("slices")
        return sum(f.getPath().getName().endswith(".json") for f in fs.listStatus(p)) if fs.exists(p) else 0

    def state(self) -> DataFrame | None:
        k = self.slices()
        return self.spark.read.parquet(f"{self.path}/state/slice={k - 1}") if k else None

    def add(self, rows: DataFrame, close: bool = False) -> int:
        """Build a slice; gives its number. What an earlier try of the same slice left is replaced."""
        k = self.slices()
        done, state = build_slice(rows, self.state(), self.spec, self.options, close)
        done.write.mode("overwrite").parquet(f"{self.path}/steps/slice={k}")
        state.write.mode("overwrite").parquet(f"{self.path}/state/slice={k}")
        fs, p = self._folder(f"slices/{k}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"slice": k, "closed": close}).encode()))
        out.close()
        return k

    def close(self, like: DataFrame) -> int:
        """Make the rows that are still open final: nothing later will come. ``like`` gives the
        columns of a slice."""
        return self.add(like.limit(0), close=True)

    def steps(self) -> DataFrame:
        """The step table of all visible slices."""
        paths = [f"{self.path}/steps/slice={k}" for k in range(self.slices())]
        return self.spark.read.option("basePath", f"{self.path}/steps").parquet(*paths)


def aligned_month(quality: DataFrame, current: DataFrame, keys: list[str], current_col: str) -> DataFrame:
    """J1 for one slice: quality rows with their current, NaN as missing."""
    from ..operators.joins import align_sources
    return align_sources(quality, current.select(*keys, nan_to_null(current_col).alias(current_col)), keys)
