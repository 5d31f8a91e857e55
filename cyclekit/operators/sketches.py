"""Mergeable quantile sketches (A10, A15 at scale): one stored sketch per group and period,
merged for any range instead of reading its rows again.

Spark's KLL sketches; with the default ``k`` the rank of a returned quantile is off by less
than RANK_ERROR of the count (99 % confidence)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 400
RANK_ERROR = 0.0085


def quantile_sketches(df: DataFrame, groups: list[str | Column], value: str, k: int = K) -> DataFrame:
    """``groups, sketch, n``: one row a group; null and NaN values are left out, as are groups
    without any value."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*groups).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(v).cast("long").alias("n"))


def merged_quantiles(sketches: DataFrame, probabilities: list[float], groups: list[str] | None = None, k: int = K) -> DataFrame:
    """``groups, n, quantiles``: quantiles of all values behind the given sketches."""
    merged = [F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"), F.sum("n").cast("long").alias("n")]
    d = sketches.groupBy(*groups).agg(*merged) if groups else sketches.agg(*merged)
    q = F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(p)) for p in probabilities])
    return d.select(*(groups or []), "n", F.when(F.col("n") > 0, q).alias("quantiles"))
