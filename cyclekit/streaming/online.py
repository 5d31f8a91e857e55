"""Online chain: validation (ST2) -> control signal (ST1) -> audit (ST4), and its restart.

Two streaming queries read the same source: rejected events go to a quarantine table, with the
names of the rules they break, and valid ones through the stateful step into the audit
table. Both resume from their checkpoints: state, source offsets and sinks agree after a
stop or a failure at any point (the audit sink replaces a batch that is run again; the
quarantine is Spark's file sink)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from . import control as ST


@dataclass(frozen=True)
class ChainPaths:
    """Folders on shared storage: the event files, the two tables, the queries' checkpoints."""
    source: str
    audit: str
    quarantine: str
    checkpoint: str


#: Features that a client must send (all but those with bounds, which are required by their rule).
REQUIRED = [c for c in ST.SENSOR_FIELDS if c not in ("nh4", "no3", "ph", "temp", "current_r", "hour_sin", "hour_cos")]


def append_slice(events: DataFrame, source: str, files: int = 4) -> None:
    """Add a slice of events, later than all before, as ``files`` files: those of one reactor stay
    together, and the file source takes older files first."""
    events.repartition(files, "reactor").write.mode("append").parquet(source)


def start_chain(spark: SparkSession, paths: ChainPaths, step_pred: Column | Callable[[DataFrame], DataFrame] | None = None,
                scaler: ST.Scaler | None = None, reactors: list[str] | DataFrame | None = None, required: list[str] | None = REQUIRED,
                max_files: int = 4, writer: Callable[[DataFrame, int], None] | None = None,
                trigger: dict | None = None) -> list[StreamingQuery]:
    """Start both queries. A micro-batch reads at most ``max_files`` files. ``trigger`` as for
    ``DataStreamWriter.trigger``; by default all that is there is taken, in as many
    micro-batches as the limit asks for, and the queries end."""
    events = (spark.readStream.schema(ST.EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
              .option("latestFirst", "false").parquet(paths.source))
    valid, bad = ST.validate_stream(events, reactors, required)
    decisions = ST.control_stream(valid.select(*ST.EVENT_SCHEMA.names), step_pred, scaler)
    trigger = trigger or {"availableNow": True}
    rejected = (bad.withColumn("date", F.to_date("event_time")).writeStream.format("parquet").partitionBy("date")
                .option("path", paths.quarantine).option("checkpointLocation", f"{paths.checkpoint}/quarantine")
                .outputMode("append").trigger(**trigger).start())
    control = (decisions.writeStream.foreachBatch(writer or ST.audit_writer(paths.audit, partition_by=("date",)))
               .option("checkpointLocation", f"{paths.checkpoint}/control").outputMode("append").trigger(**trigger).start())
    return [rejected, control]


def run_chain(spark: SparkSession, paths: ChainPaths, **options) -> list[int]:
    """Take all that is in the source, then stop. Gives the number of micro-batches that each
    query ran; a failure of either is raised after both have ended."""
    queries = start_chain(spark, paths, **options)
    failures = []
    for q in queries:
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001  the other query is awaited first
            failures.append(e)
    if failures:
        raise failures[0]
    return [sum(p.numInputRows > 0 for p in q.recentProgress) for q in queries]


def chain_tables(spark: SparkSession, paths: ChainPaths) -> tuple[DataFrame, DataFrame]:
    """(audit table, quarantine table) as they stand."""
    return spark.read.parquet(paths.audit), spark.read.parquet(paths.quarantine)
