"""K-d tree sharding with DataFrame functions only.

A node of the tree is split along its widest metadata dimension at a weighted quantile of
the rows' bytes (the median for an even number of leaves below it), until a leaf holds
the target bytes. Coordinates are 48-bit integers: 18 bits of the scaled dimension, then
30 bits of a row hash, so equal values, hot groups and copies are split too. A quantile
is found exactly on that grid by three grouped sums of 16 bits each, for all nodes of a
level together; only the split points (one row a node) come to the driver."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

DIGITS, DIGIT = 3, 16


@dataclass
class Node:
    leaves: int
    first: int                       # number of its first shard
    dim: str | None = None
    cut: int | None = None           # coordinates below go left
    left: "Node | None" = None
    right: "Node | None" = None

    def label(self, value) -> Column:
        """``value(leaf)`` of the leaf that a row falls into, as nested conditions."""
        if self.left is None:
            return value(self)
        return F.when(F.col(f"y_{self.dim}") < F.lit(self.cut), self.left.label(value)).otherwise(self.right.label(value))

    def ends(self) -> list["Node"]:
        return [self] if self.left is None else self.left.ends() + self.right.ends()


def _coordinates(df: DataFrame, dims: list[str]) -> DataFrame:
    """``y_<dim>`` on the 48-bit grid; null dimensions count as the least value."""
    ends = df.agg(*[f(F.col(d).cast("double")).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for d in dims:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        if lo is None or hi <= lo:
            x = F.lit(0).cast("long")
        else:
            part = (F.coalesce(F.col(d).cast("double"), F.lit(lo)) - F.lit(lo)) / F.lit(hi - lo)
            x = F.least((part * F.lit(2 ** 18)).cast("long"), F.lit(2 ** 18 - 1))
        df = df.withColumn(f"y_{d}", F.shiftleft(x, 30).bitwiseOR(F.col("_u")))
    return df


def _level(df: DataFrame, root: Node, dims: list[str]) -> bool:
    """Split every leaf that stands for several shards; says whether there was one."""
    todo = {n.first: n for n in root.ends() if n.leaves > 1}
    if not todo:
        return False
    def rows_of(columns) -> DataFrame:       # inline keeps the nested condition in one place of the plan
        label = root.label(lambda n: F.struct(*columns(n)) if n.leaves > 1 else F.lit(None))
        return df.select("_w", F.inline(F.array(label))).where("node is not null")

    spread = rows_of(lambda n: [F.lit(n.first).alias("node"), *[F.col(f"y_{d}") for d in dims]]).groupBy("node").agg(
        F.sum("_w").alias("w"), *[(F.max(f"y_{d}") - F.min(f"y_{d}")).alias(d) for d in dims]).collect()
    at = {}
    for r in spread:
        n = todo[r["node"]]
        n.dim = max(dims, key=lambda d: (r[d], -dims.index(d)))
        at[n.first] = [0, r["w"] * (n.leaves // 2) / n.leaves]       # prefix found so far, bytes wanted left of the cut
    for digit in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - digit)
        bins = rows_of(lambda n: [
            F.lit(n.first).alias("node"), (F.col(f"y_{n.dim}") if n.first in at else F.lit(None).cast("long")).alias("y"),
            F.lit(at[n.first][0] if n.first in at else 0).cast("long").alias("prefix")])
        if digit:
            bins = bins.where(F.shiftright("y", shift + DIGIT) == F.col("prefix"))
        bins = bins.where("y is not null").groupBy("node", F.shiftright("y", shift).alias("bin")).agg(F.sum("_w").alias("w"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        want = F.lit(None).cast("double")
        for i, (_, rest) in at.items():
            want = F.when(F.col("node") == i, F.lit(float(rest))).otherwise(want)
        found = bins.withColumn("c", F.sum("w").over(upto)).where(F.col("c") >= want).groupBy("node").agg(
            F.min_by(F.struct("bin", "c", "w"), "bin").alias("b")).collect()
        for r in found:
            at[r["node"]] = [r["b"]["bin"], at[r["node"]][1] - (r["b"]["c"] - r["b"]["w"])]
    for i, n in todo.items():
        half = n.leaves // 2
        n.dim = n.dim or dims[0]
        n.cut = at[i][0] + 1 if i in at else 0
        n.left, n.right = Node(half, n.first), Node(n.leaves - half, n.first + half)
    return True


def kd_shards(df: DataFrame, dims: list[str], weight: str, shards: int | None = None,
              target_bytes: int | None = None, row_key: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard`` (0 to n - 1, bytes near equal) and ``slot`` (gapless from 0 within a
    shard). Give the number of shards, or the target bytes of a leaf.

    ``dims`` are numeric columns (a null counts as the least value), ``weight`` the bytes
    of a row (null: 0). ``row_key`` columns seed the hash that splits equal coordinates;
    rows that repeat wholly are told apart by their place. The tree is a nested condition
    of ``shards - 1`` comparisons, meant for up to about a thousand shards. An empty
    table gives no rows."""
    cols = df.columns
    row = F.monotonically_increasing_id()
    marked = df.withColumn("_row", row).withColumn("_w", F.coalesce(F.col(weight).cast("long"), F.lit(0)))
    u = F.pmod(F.xxhash64(*(row_key or cols)), F.lit(1 << 22))
    marked = stage(marked.withColumn("_u", F.shiftleft(u, 8).bitwiseOR(F.pmod(F.xxhash64("_row"), F.lit(256)))), "shard")
    rows, total = marked.agg(F.count("*"), F.sum("_w")).first()
    n = shards or max(1, -(-(total or 0) // target_bytes))
    root = Node(n, 0)
    spots = stage(_coordinates(marked, dims), "shard")
    while rows and _level(spots, root, dims):
        pass
    placed = spots.select(*[F.col(f"`{c}`") for c in cols], "_row", F.explode(F.array(
        root.label(lambda leaf: F.lit(leaf.first)))).alias("shard"))

    # slots: a running count over hash parts of each shard, then over the part's rows
    parts = max(1, rows // (n * 50_000))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n")).select(
        "shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("shard", "_part").orderBy("_row")
    done = placed.withColumn("_k", F.row_number().over(own) - 1).join(base, ["shard", "_part"])
    return done.select(*[F.col(f"`{c}`") for c in cols], "shard", (F.col("_base") + F.col("_k")).cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The documents' sizes (UTF-8 bytes plus 16), checksums, shards and slots."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def number(c: str) -> Column:            # a place in [0, 1) for each distinct string
        return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(2.0 ** 32)

    meta = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       number("source").alias("source_at"), number("lang").alias("lang_at"),
                       F.log1p(F.octet_length(text).cast("double")).alias("log_size"))
    placed = kd_shards(meta, ["log_size", "source_at", "lang_at", "doc_id"], "size", shards, row_key=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
