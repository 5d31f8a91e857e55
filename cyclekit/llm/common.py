"""Reading tables and cutting lineage for the operators of this package."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back. Cuts the
    lineage: a lost executor costs the running stage only, never the steps before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_stage(df: DataFrame) -> None:
    """Remove the files of a staged frame that nothing reads any more: the caller has
    written what follows from it."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def _reads_files(df: DataFrame) -> bool:
    """Whether the frame is files read as they are, at most with rows or columns left out."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row in column ``name``. Rows of Parquet files
    are numbered by file and place in the file, so nothing is written and every reader
    sees the same number; rows of any other frame (a join, say, which repeats places) are
    written once. The driver holds the names of the files."""
    at = None
    if _reads_files(df):
        try:
            at = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
        except AnalysisException:                # a format whose rows have no place
            pass
    if at is None:
        return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    files = sorted(r[0] for r in at.select("_f").distinct().collect())
    place = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "_f string, _base long")
    small = len(files) <= 100_000            # names of more files are not sent to every task
    return at.join(F.broadcast(place) if small else place, "_f").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_i")).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
