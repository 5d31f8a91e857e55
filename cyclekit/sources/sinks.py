"""Sinks (IO3, IO4, IO6). Paths must be on shared storage."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import METRICS_SCHEMA


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   mode: str = "overwrite", fmt: str = "parquet") -> None:
    """IO3: write a feature table, partitioned (e.g. by site, month) for pruning; rows are
    clustered by the partition columns first, a few writers a folder."""
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_audit(df: DataFrame, path: str, batch_id: int | None = None,
                 partition_by: tuple[str, ...] = ("reactor", "date"), writers: int = 4) -> None:
    """IO4: append decisions to a partitioned Parquet audit table. With a ``batch_id``
    the batch has a folder of its own, which the write replaces whole: a micro-batch
    that is replayed, also after a write that failed midway, neither doubles nor loses
    rows, and the growing table is never read. Rows of one folder are spread over a few
    writers, so a hot day is not one task's work."""
    d = df
    if "date" in partition_by and "date" not in d.columns:
        d = d.withColumn("date", F.to_date("timestamp"))
    if batch_id is not None:
        d = d.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(writers)))
        d = d.repartition(*partition_by, "_salt").drop("_salt")
        d.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch_id={batch_id}")
        return
    d.repartition(*partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert_metrics(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("section", "metric"),
                   ts: str = "updated_at") -> DataFrame:
    """IO6: merge new metric values over stored ones; the latest value per
    (section, metric) wins, on a tie the new one, untouched metrics stay. Groups are one
    metric each."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def metric_rows(wide: DataFrame, section: str, at, names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows of METRICS_SCHEMA from a table of metric columns, a row a group: section and metric
    name the values (``by`` columns are added to the section), ``at`` is their time."""
    by = by or []
    names = names or [c for c in wide.columns if c not in by]
    tag = F.concat_ws("/", F.lit(section), *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by])
    flat = wide.select(tag.alias("section"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot("section", names, "metric", "value")
    return flat.select("section", "metric", "value", F.lit(at).cast("timestamp").alias("updated_at"))


class MetricStore:
    """IO6 as a table of versions under ``path`` (shared storage): an upsert writes the merged table as
    ``v<k>`` and then ``v<k>.json``, which makes it the current one. A failed write leaves
    the version before; earlier versions stay readable. One writer at a time: of two that
    take the same number, one fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, place: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The current version, 0 for none."""
        fs, p = self._at("")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The current or an earlier version; without any, an empty table."""
        k = self.version() if version is None else version
        return self.spark.read.schema(METRICS_SCHEMA).parquet(f"{self.path}/v{k}") if k else self.spark.createDataFrame([], METRICS_SCHEMA)

    def upsert(self, new: DataFrame) -> int:
        """Merge new values (rows of METRICS_SCHEMA) over the current version; gives the new one."""
        k = self.version() + 1
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in METRICS_SCHEMA.fields])
        upsert_metrics(self.read(), new).write.mode("overwrite").parquet(f"{self.path}/v{k}")
        fs, p = self._at(f"v{k}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"version": k}).encode()))
        out.close()
        return k
