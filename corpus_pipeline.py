"""Corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, tokens.

Each stage gets what its predecessor kept and returns the columns of ``documents``; the
last one returns the digests of the encoded texts. The filtering stages decide row by row,
so rows without an id, and rows that repeat an id with another text, go or stay by their
own text: rows are told apart by their place in the files that the predecessor wrote.
``run`` writes every stage as Parquet into the shared folder, reads it back, and deletes it
once its successor is written."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclekit.llm import byte_bpe, decontaminate, ngram_join, quality_rules, secret_scan
from cyclekit.llm.common import delete_stage, free_name, numbered, stage, table

REDACTED = "[SECRET]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    gone = stage(quality_rules.judged(rows, row).where("not kept").select(row), "gone")
    return rows.join(gone, row, "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row with the smallest id stays (one without an
    id only if none has one); of rows without words that repeat an id and text, one."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    groups = ngram_join.jaccard_components(rows, row).toDF("row", "n", "component")
    own = rows.select(F.col(row).alias("row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    empty = F.col("n") == 0
    first = groups.join(own, "row").groupBy(
        F.when(~empty, F.col("component")).alias("c"), F.when(empty, F.struct("doc_id", "same")).alias("e")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = stage(decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), row).select(row).distinct(), "found")
    return rows.join(found, row, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    spans = free_name(docs, "_spans")
    clean = secret_scan.scan(docs, redact=REDACTED, out=spans)
    changed = F.size(spans) > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded again."""
    import public_tokenizers as tokenizers

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip_digests(docs, ranks, tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the component, SimHash, scan and merge stages; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            delete_stage(last)
        last = docs
    return docs
