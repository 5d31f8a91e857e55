"""Models on Spark ML (ML1-ML6, A14) and ranked importance tables.

Both regressors of the source system are re-aimed at Spark ML gradient-boosted
trees: the cycle-start model on start rows, the step model on flattened
7-row windows. Scoring, importance and audits stay DataFrame jobs."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip_nonneg
from ..schema import WATER_QUALITY_FEATURES, FeatureSpec


def top_features(scores: DataFrame, name: str, score: str, k: int = 5) -> DataFrame:
    """SO3: top-k rows by score (ties by name) with their rank. ``scores`` has one
    row per feature, so the global ordering is over a handful of rows."""
    w = Window.orderBy(F.col(score).desc(), F.col(name))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class GBTParams:
    """Source settings mapped to Spark ML: learning rate .05, depth 6, row and
    column sampling .8, min child weight 5 (= rows per leaf under squared loss),
    seed 42. Early stopping uses a validation indicator column."""
    max_iter: int = 1000      # the validation split stops it earlier
    step_size: float = 0.05
    max_depth: int = 6
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    min_instances_per_node: int = 5
    seed: int = 42
    validation_tol: float = 0.01
    max_bins: int = 64


def make_pipeline(features: list[str], label: str, params: GBTParams = GBTParams(),
                  validation_col: str | None = None, prediction: str = "prediction") -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    gbt = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol=prediction,
                       maxIter=params.max_iter, stepSize=params.step_size, maxDepth=params.max_depth,
                       subsamplingRate=params.subsampling_rate, featureSubsetStrategy=params.feature_subset,
                       minInstancesPerNode=params.min_instances_per_node, seed=params.seed,
                       maxBins=params.max_bins, lossType="squared")
    if validation_col:
        gbt = gbt.setParams(validationIndicatorCol=validation_col, validationTol=params.validation_tol)
    return Pipeline(stages=[assembler, gbt])


def fit_contract(train: DataFrame, spec: FeatureSpec, params: GBTParams = GBTParams(),
                 validation_col: str | None = None) -> PipelineModel:
    """ML1/ML2 fit by a feature contract: leaks, repeated and missing columns are errors."""
    spec.assert_valid(train.schema)
    return fit_model(train, list(spec.features), spec.target, params, validation_col)


def vector_column(array_col: str, out: str = "_features") -> Column:
    """An array column as the feature vector, without a column per element."""
    return array_to_vector(F.col(array_col).cast("array<double>")).alias(out)


def whole_windows(df: DataFrame, array_col: str) -> DataFrame:
    """Rows whose window has no missing value (ML3: the others cannot be scored)."""
    return df.filter(F.forall(array_col, lambda v: v.isNotNull() & ~F.isnan(v)))


def fit_window_model(train: DataFrame, array_col: str, label: str, params: GBTParams = GBTParams(),
                     validation_col: str | None = None) -> PipelineModel:
    """ML2 fit on flattened windows in one array column."""
    cols = [vector_column(array_col), label] + ([validation_col] if validation_col else [])
    gbt = make_pipeline([], label, params, validation_col).getStages()[-1]
    return Pipeline(stages=[gbt]).fit(whole_windows(train, array_col).select(*cols))


def fit_huber(train: DataFrame, array_col: str, label: str, epsilon: float = 1.35, reg: float = 1e-4,
              max_iter: int = 100) -> PipelineModel:
    """ML2's robust baseline: a linear model under the Huber loss on flattened windows."""
    line = LinearRegression(featuresCol="_features", labelCol=label, loss="huber", epsilon=epsilon, regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[line]).fit(whole_windows(train, array_col).select(vector_column(array_col), F.col(label).cast("double").alias(label)))


def score_windows(model: PipelineModel, df: DataFrame, array_col: str, out: str = "pred") -> DataFrame:
    """ML3 on flattened windows, batch or stream, clipped at 0. Rows without a whole window have
    no prediction (null) and stay."""
    whole = F.coalesce((F.size(array_col) > 0) & F.forall(array_col, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    n = model.stages[-1].numFeatures
    zero = F.array_repeat(F.lit(0.0), n)
    d = df.withColumn("_features", array_to_vector(F.when(whole, F.col(array_col).cast("array<double>")).otherwise(zero)))
    d = model.transform(d).withColumn(out, F.when(whole, clip_nonneg("prediction")))
    return d.drop("prediction", "_features")


def fit_model(train: DataFrame, features: list[str], label: str, params: GBTParams = GBTParams(),
              validation_col: str | None = None) -> PipelineModel:
    """ML1/ML2 fit. Rows with a missing feature are skipped by the assembler."""
    cols = list(features) + [label] + ([validation_col] if validation_col else [])
    return make_pipeline(features, label, params, validation_col).fit(train.select(*cols))


def score(model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    """ML3: batch prediction, clipped at 0; rows with missing features are dropped."""
    return model.transform(df).withColumn(out, clip_nonneg("prediction")).drop("prediction", "_features")


def feature_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """ML4: split-gain importances as a table (rank, feature, importance) plus the
    dominance flag (top1 / top2 >= 3). The vector has one value per feature."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    d = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    d = d.withColumn("rank", F.row_number().over(w))
    top = d.filter(F.col("rank") <= 2).agg(F.max("importance").alias("t1"), F.min("importance").alias("t2"))
    return d.crossJoin(F.broadcast(top)).withColumn(
        "dominant", (F.col("rank") == 1) & (F.col("t2") > 0) & (F.col("t1") / F.col("t2") >= 3.0)).drop("t1", "t2")


def sample_n(df: DataFrame, key_cols: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows: the n smallest MD5 hashes of (seed, key).
    Spark runs this as a per-partition top-n plus a merge of n-row lists."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def permutation_importance(model: PipelineModel, sample: DataFrame, features: list[str], label: str,
                           key_cols: list[str], seed: int = 7, bucket_rows: int = 10_000) -> DataFrame:
    """ML5 re-aimed: mean absolute error increase when one feature column is
    permuted across all given rows. All features are scored in one job: a union of
    permuted copies, one model transform, one aggregation. Rows fall into random hash
    buckets of about ``bucket_rows``; inside a bucket the rank in one hash order is
    paired with the rank in another, so no window holds more than a bucket."""
    buckets = max(1, -(-sample.count() // bucket_rows))
    b = F.pmod(F.xxhash64(F.lit(seed + 2), *key_cols), F.lit(buckets))

    def ranked(out: str, s: int) -> DataFrame:
        w = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(s), *key_cols), *key_cols)
        return sample.withColumn("_b", b).withColumn(out, F.row_number().over(w))

    base, donor = ranked("_ra", seed), ranked("_rb", seed + 1)
    copies = [base.withColumn("_feature", F.lit("__baseline__")).drop("_ra", "_b")]
    for f in features:
        d = donor.select("_b", F.col("_rb").alias("_ra"), F.col(f).alias("_pv"))
        p = base.join(d, ["_b", "_ra"]).withColumn(f, F.col("_pv")).drop("_pv", "_b", "_ra")
        copies.append(p.withColumn("_feature", F.lit(f)))
    allc = copies[0]
    for c in copies[1:]:
        allc = allc.unionByName(c)
    scored = score(model, allc)
    mae = scored.groupBy("_feature").agg(F.avg(F.abs(F.col("pred") - F.col(label))).alias("mae"))
    b = mae.filter(F.col("_feature") == "__baseline__").select(F.col("mae").alias("base_mae"))
    out = mae.filter(F.col("_feature") != "__baseline__").crossJoin(F.broadcast(b))
    out = out.select(F.col("_feature").alias("feature"), (F.col("mae") - F.col("base_mae")).alias("importance"))
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    out = out.withColumn("rank", F.row_number().over(w))
    quality_in_top5 = F.max(F.when((F.col("rank") <= 5) & F.col("feature").isin(*WATER_QUALITY_FEATURES), 1)) \
        .over(Window.partitionBy(F.lit(1)))
    return out.withColumn("quality_in_top5", F.coalesce(quality_in_top5, F.lit(0)) == 1)


def monotone_audit(model: PipelineModel | Callable[[DataFrame, list[str]], DataFrame], sample: DataFrame, features: list[str],
                   audit_cols: list[str], key_cols: list[str], grid_points: int = 10) -> DataFrame:
    """ML6: Spark trees take no monotone constraint, so audit it: for each sampled
    row and audited feature, sweep the feature over a quantile grid (exploded, no
    join), score, and count steps where the prediction falls. Per-(row, feature)
    windows hold ``grid_points`` rows. Instead of a model a function may be given that adds
    ``pred`` to rows with the given keys."""
    probs = [i / (grid_points - 1) for i in range(grid_points)]
    grids = sample.agg(*[F.percentile_approx(c, probs, 1000).alias(f"_g_{c}") for c in audit_cols])
    d = sample.crossJoin(F.broadcast(grids))  # one row of grid values
    parts = []
    for c in audit_cols:
        g = d.select(*key_cols, *[x for x in features if x != c],
                     F.posexplode(F.col(f"_g_{c}")).alias("_gi", c)).withColumn("_feature", F.lit(c))
        parts.append(g.select(*key_cols, *features, "_gi", "_feature"))
    allg = parts[0]
    for p in parts[1:]:
        allg = allg.unionByName(p)
    s = model(allg, [*key_cols, "_feature", "_gi"]) if callable(model) else score(model, allg)
    w = Window.partitionBy(*key_cols, "_feature").orderBy("_gi")
    s = s.withColumn("_drop", (F.col("pred") < F.lag("pred").over(w) - F.lit(1e-9)).cast("int"))
    return (s.groupBy(F.col("_feature").alias("feature"))
             .agg(F.count(F.lit(1)).cast("long").alias("n_points"),
                  F.sum(F.coalesce("_drop", F.lit(0))).cast("long").alias("n_decreasing")))
