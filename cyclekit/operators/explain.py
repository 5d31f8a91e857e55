"""What a tree model says (ML5) and a monotone correction of it (ML6).

``tree_nodes`` turns a fitted gradient-boosted model into a table of nodes. Its size is the
model's (trees x 2^(depth + 1)), whatever the data, so it is broadcast to the rows."""
from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import models

MAX_NODES = 1 << 20


def tree_nodes(model: PipelineModel, path: str) -> DataFrame:
    """``tree, weight, node, value, left, right, feature, threshold`` of all trees; leaves have a null
    feature. ``path``: a fresh folder on shared storage for the model's own tables."""
    gbt = model.stages[-1]
    gbt.write().save(path)
    spark = SparkSession.getActiveSession()
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(gbt.treeWeights)], "tree int, weight double")
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["prediction"].alias("value"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(~leaf, n["split"]["featureIndex"]).alias("feature"), F.when(~leaf, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"))
    if nodes.count() > MAX_NODES:
        raise ValueError(f"a model of more than {MAX_NODES} nodes is not broadcast")
    return nodes.join(weights, "tree")


def contributions(df: DataFrame, nodes: DataFrame, features: list[str], keys: list[str], depth: int) -> DataFrame:
    """``keys, base, c_<feature> ...``: the additive contributions to each row's raw prediction.
    Along a row's path through a tree every split moves the value from the node's to the
    child's; the move belongs to the split's feature. Base and contributions sum to the
    prediction. ``depth``: of the deepest tree. Rows with a missing feature are left out, as
    the model does."""
    nodes = F.broadcast(nodes)
    x = F.array(*[F.col(c).cast("double") for c in features])
    whole = df.select(*keys, x.alias("_x")).filter(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    zero = F.array_repeat(F.lit(0.0), len(features))
    root = nodes.filter("node = 0").select("tree", "weight", F.col("node").alias("_node"), F.col("value").alias("_value"), F.col("value").alias("_root"))
    at = whole.join(root).withColumn("_c", zero)                    # a row and tree, the node it is at
    step = nodes.select("tree", F.col("node").alias("_node"), "left", "right", "feature", "threshold")
    value = nodes.select("tree", F.col("node").alias("_next"), F.col("value").alias("_new"))
    for _ in range(depth):
        at = at.join(step, ["tree", "_node"])
        child = F.when(F.col("feature").isNull(), F.col("_node")).when(
            F.get("_x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.withColumn("_next", child).join(value, ["tree", "_next"])
        move = F.col("_new") - F.col("_value")
        moved = F.transform("_c", lambda c, i: F.when(i == F.col("feature"), c + move).otherwise(c))
        at = at.select(*keys, "_x", "tree", "weight", "_root", moved.alias("_c"), F.col("_next").alias("_node"), F.col("_new").alias("_value"))
    return at.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("_root")).alias("base"),
        *[F.sum(F.col("weight") * F.get("_c", F.lit(i))).alias(f"c_{f}") for i, f in enumerate(features)])


def contribution_importance(parts: DataFrame, features: list[str]) -> DataFrame:
    """ML5: ``feature, importance`` (mean absolute contribution) ``, rank``. One row a feature."""
    wide = parts.agg(*[F.avg(F.abs(f"c_{f}")).alias(f) for f in features])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance")) for f in features])).alias("r")).select("r.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def monotone_score(model: PipelineModel, nodes: DataFrame, df: DataFrame, features: list[str], col: str, keys: list[str],
                   out: str = "pred") -> DataFrame:
    """ML6: scores that never fall as ``col`` grows, everything else equal: the greatest prediction
    at or below the row's value. A tree model is constant between its split points, so one
    evaluation per interval below the row's is exact; they are at most the model's bins. Adds
    ``out`` to the rows; rows that the model cannot score are dropped."""
    cuts = [r[0] for r in nodes.filter(F.col("feature") == features.index(col)).select("threshold").distinct().orderBy("threshold").collect()]
    places = [*cuts, (cuts[-1] + 1.0 if cuts else 0.0)]           # a value within each interval: its upper end, closed
    grid = F.array(*[F.lit(float(p)) for p in places])
    below = reduce(lambda a, b: a + b, [(F.col(col) > F.lit(c)).cast("int") for c in cuts], F.lit(0)) + 1
    wide = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(
        *keys, *[c for c in features if c != col and c not in keys], F.explode(F.slice(grid, 1, below)).alias(col))
    best = models.score(model, wide, out).groupBy(*keys).agg(F.max(out).alias(out))
    return df.join(best, keys)
