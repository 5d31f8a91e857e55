"""Readers (IO1, IO2). Declared schemas only; never ``inferSchema``."""
from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns by name (missing ones null), cast; NaN texts become null."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.col(f"`{f.name}`").alias(f.name))
        else:
            c = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
            out.append((F.nanvl(c, F.lit(None).cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name))
    return df.select(*out, "source_file")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]), [])]


def _names(cells: list[str], schema: T.StructType, header_cell: str) -> tuple[list[str], bool]:
    """(column names of a file, whether its first line is a header). A header holds
    ``header_cell`` in any place; its cells name the columns. Other files take the declared
    names by place and may be narrower, not wider."""
    if header_cell in cells:
        return [c or f"_blank{i}" for i, c in enumerate(cells)], True
    if len(cells) > len(schema.fields):
        raise ValueError(f"a file without a header has {len(cells)} columns, {len(schema.fields)} are declared")
    return [f.name for f in schema.fields[:len(cells)]], False


def read_sensor_csv(spark: SparkSession, paths: list[str], schema: T.StructType, header_cell: str,
                    encoding: str = "UTF-8") -> DataFrame:
    """IO1: CSV files that may or may not carry a header row, in any column order.

    The first line of every file comes from one distributed pass (one row a file). Files
    with equal headers (or, without a header, equal widths) are read together with their
    own column names; rows whose number of cells differs from the file's fail the read
    instead of losing cells. Empty files give no rows. Legacy charsets (cp949) need
    ``spark.sql.legacy.javaCharsets=true`` on the session."""
    lines = (spark.read.option("encoding", encoding).text(paths)
             .select(F.col("_metadata.file_path").alias("path"), "value",
                     F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")))
    first = lines.where("at.b = 0").groupBy("path").agg(F.min_by("value", F.col("at.i")).alias("line"))
    groups: dict[tuple, list[str]] = {}
    for path, line in first.toLocalIterator():
        names, header = _names(_cells(line), schema, header_cell)
        groups.setdefault((tuple(names), header), []).append(path)
    frames = []
    for (names, header), files in sorted(groups.items()):
        raw = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
        d = (spark.read.schema(raw).option("header", str(header).lower()).option("enforceSchema", "true")
             .option("encoding", encoding).option("mode", "FAILFAST").csv(files))
        frames.append(_typed(d.select("*", F.col("_metadata.file_name").alias("source_file")), schema))
    if not frames:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]))
    return reduce(lambda x, y: x.unionByName(y), frames)


def read_months(spark: SparkSession, month_paths: dict[int, str], fmt: str = "parquet") -> DataFrame:
    """IO2: read one file per month, tag rows with month and source file, union
    by name; a missing file is an error."""
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    frames = []
    for month, path in sorted(month_paths.items()):
        p = jvm_fs.Path(path)
        if not p.getFileSystem(conf).exists(p):
            raise FileNotFoundError(path)
        d = spark.read.format(fmt).load(path)
        frames.append(d.select("*", F.lit(month).cast("int").alias("month"),
                               F.col("_metadata.file_name").alias("source_file")))
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_sensor_csv_any_charset(spark: SparkSession, paths: list[str], schema: T.StructType, header_cell: str,
                                encoding: str = "cp949") -> DataFrame:
    """IO1 for legacy charsets. Spark 4 refuses cp949 in the CSV reader unless the
    session sets ``spark.sql.legacy.javaCharsets=true``; with that flag the plain
    reader is used. Otherwise each file is read as bytes (``binaryFile``; a file is
    the unit a task reads anyway), decoded strictly and parsed in ``mapInPandas``
    with the same header rule, in pieces; a row with a wrong number of cells is an error."""
    legacy = str(spark.conf.get("spark.sql.legacy.javaCharsets", "false")).lower() == "true"
    if legacy or encoding.lower().replace("-", "") in ("utf8",):
        return read_sensor_csv(spark, paths, schema, header_cell, encoding)
    import pandas as pd

    declared = [f.name for f in schema.fields]
    out_schema = T.StructType([T.StructField(n, T.StringType(), True) for n in declared] +
                              [T.StructField("source_file", T.StringType(), True)])

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, names = [], None
                for rec in csv.reader(io.TextIOWrapper(io.BytesIO(bytes(content)), encoding=encoding, newline="")):
                    if not rec:
                        continue
                    if names is None:
                        names, header = _names([c.strip() for c in rec], schema, header_cell)
                        if header:
                            continue
                    if len(rec) != len(names):
                        raise ValueError(f"{path}: a row of {len(rec)} cells, not {len(names)}")
                    cell = dict(zip(names, rec))
                    rows.append([cell.get(n) or None for n in declared] + [path.rsplit("/", 1)[-1]])
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=[*declared, "source_file"])
                        rows = []
                yield pd.DataFrame(rows, columns=[*declared, "source_file"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return _typed(files.mapInPandas(decode, out_schema), schema)
