"""URL filter: fixed host rules first, then association rules mined from labelled URLs.

Mining: a URL is a basket of typed tokens (host, its suffixes, path parts, query keys,
scheme). Spark's FP-growth mines the token sets that enough bad URLs hold, from whole
baskets in which tokens that always stand together are one item (any of them makes the same
rule). An inverted index counts each set among the good URLs, which gives its confidence. A
block rule is a set of enough support and confidence that is surer than every rule within
it. Sets and rules are tables; the driver holds the frequent tokens alone, at most the mean
number of a URL's tokens divided by the support.

Matching: the inverted index posts each rule under its rarest token; URLs look up their
tokens there and keep the rules whose tokens they all have. Equal URLs are judged once."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the host rules.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null url or one without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(`url`, instr(`url`, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):        # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, n - i + 1, i), "."))))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    steps = F.transform(parts, lambda p, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="),
                                                     F.when(p.rlike(r"^[0-9]+$"), F.lit("<number>")).otherwise(p)))
    keys = F.transform(F.regexp_extract_all(F.regexp_replace(url, "#.*", ""), F.lit(r"[?&]([^=&]*)")),
                       lambda k: F.concat(F.lit("query="), k))
    scheme = F.when(F.contains(url, F.lit("://")), F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))))
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in (suffixes, steps, keys, scheme)]))


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct non-null URLs with host, path and tokens."""
    urls = pages.select(F.col(url_col).cast("string").alias("url")).where("url is not null").distinct()
    host, path = url_parts(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    return urls.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))


@dataclass(frozen=True)
class Tokens:
    """Frequent tokens, the rarest first, and for each kept token those that always stand with it."""
    names: list[str]
    twins: list[list[str]]


RULES = "items array<int>, confidence double, support double"


def _numbered(tokens: list[str], keep: list[str]):
    """Rows (tokens, ...) -> rows (items, ...): places in ``tokens``, others left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(tokens, pa.string())
        for batch in batches:
            lists = batch.column("tokens")
            at = pc.index_in(pc.list_flatten(lists).cast(pa.string()), value_set=values)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[at.is_valid().to_numpy(zero_copy_only=False)]
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            items = pa.ListArray.from_arrays(pa.array(off, pa.int32()), at.drop_null())
            yield pa.RecordBatch.from_arrays([items, *(batch.column(c) for c in keep)], names=["items", *keep])
    return run


def baskets(rows: DataFrame, tokens: list[str], keep: list[str]) -> DataFrame:
    """``rows(tokens, ...)`` -> ``items`` (places in ``tokens``) and the columns of ``keep``."""
    kinds = ", ".join(["items array<int>", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)])
    return rows.select("tokens", *keep).mapInArrow(_numbered(tokens, keep), kinds)


def holding(rows: DataFrame, sets: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of a row (``keep``) and a set that it holds whole (all columns of ``sets``), by the
    set's rarest item. Both have a column ``items``."""
    index = sets.withColumn("_item", F.array_min("items")).withColumnRenamed("items", "needs")
    posted = rows.select(F.col("items").alias("_has"), *keep, F.explode("items").alias("_item"))
    return posted.join(index, "_item").where(F.size(F.array_except("needs", "_has")) == 0).drop("_item", "_has")


def frequent_tokens(labelled: DataFrame, least: float, least_bad: int) -> Tokens:
    """Tokens that ``least`` URLs and ``least_bad`` bad ones hold; of tokens that stand in the same
    URLs (equal sums of two hashes of the URLs that hold them) the first by name is kept."""
    h = F.xxhash64("tokens", "bad")
    seen = labelled.select(F.explode("tokens").alias("token"), "bad", h.alias("h"), F.xxhash64(h, F.lit(1)).alias("g"))
    found = seen.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).where(
        (F.col("n") >= least) & (F.col("b") >= least_bad)).collect()
    groups: dict[tuple, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["n"], r["token"])):
        groups.setdefault((r["n"], r["b"], r["h"], r["g"]), []).append(r["token"])
    return Tokens([g[0] for g in groups.values()], list(groups.values()))


def rule_table(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6) -> tuple[Tokens, DataFrame]:
    """``labelled(tokens, bad)`` -> (tokens, rules): a written table of ``items`` (places in the
    tokens), ``confidence`` and ``support``. No labelled rows, or rows of one class only, give
    no rules."""
    spark = labelled.sparkSession
    labelled = stage(labelled.select("tokens", F.col("bad").cast("boolean").alias("bad")), "urls")
    total, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    none = spark.createDataFrame([], RULES)
    if not bad or bad == total:
        return Tokens([], []), none
    rate = bad / total
    enough = max(1, math.ceil(min_support * rate * total))
    tokens = frequent_tokens(labelled, min_support * total, enough)
    if not tokens.names:
        return tokens, none
    held = stage(baskets(labelled, tokens.names, ["bad"]), "baskets")
    miner = FPGrowth(itemsCol="items", minSupport=(enough - 0.5) / bad)
    sets = miner.fit(held.where("bad").select("items")).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("b"))
    sets = stage(sets.where(F.col("b") >= enough).withColumn("set", F.monotonically_increasing_id()), "sets")
    good = holding(held.where("not bad"), sets.select("set", "items"), []).groupBy("set").agg(F.count("*").alias("g"))
    sure = sets.join(good, "set", "left").withColumn("n", F.col("b") + F.coalesce("g", F.lit(0)))
    sure = stage(sure.where((F.col("b") / F.col("n") >= min_confidence) & (F.col("b") / total >= min_support * rate)).select("set", "items", "b", "n"), "sure")
    # a rule within the set that is as sure makes the set needless
    inner = sure.select("items", F.col("b").alias("ib"), F.col("n").alias("i_n"))
    needless = holding(sure.select("items", "set", "b", "n"), inner, ["set", "b", "n", F.size("items").alias("size")]).where(
        (F.size("needs") < F.col("size")) & (F.col("ib") * F.col("n") >= F.col("b") * F.col("i_n"))).select("set").distinct()
    rules = sure.join(needless, "set", "left_anti").select(
        "items", (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / F.lit(total)).alias("support"))
    return tokens, stage(rules, "rules")


def mine_rules(labelled: DataFrame, min_support: float = 0.005,
               min_confidence: float = 0.6) -> list[tuple[tuple[str, ...], float, float]]:
    """The rules as a list to look at, (tokens, confidence, support), most sure first; tokens that
    always stand together give a rule each. Judging reads the table instead."""
    tokens, rules = rule_table(labelled, min_support, min_confidence)
    out = [(tuple(sorted(names)), r["confidence"], r["support"]) for r in rules.toLocalIterator()
           for names in product(*(tokens.twins[i] for i in r["items"]))]
    return sorted(out, key=lambda r: (-r[1], -r[2], r[0]))


def matches(urls: DataFrame, tokens: Tokens, rules: DataFrame) -> DataFrame:
    """``url, mined`` of URLs that a mined rule fits: the surest rule, its tokens joined."""
    if not tokens.names:
        return urls.select("url", F.lit(None).cast("string").alias("mined")).limit(0)
    names = rules.join(_names(urls.sparkSession, tokens, rules), "items")
    hit = holding(baskets(urls, tokens.names, ["url"]), names, ["url"])
    return hit.groupBy("url").agg(F.min(F.struct(-F.col("confidence"), -F.col("support"), "names")).alias("r")).select(
        "url", F.array_join("r.names", " & ").alias("mined"))


def _names(spark, tokens: Tokens, rules: DataFrame) -> DataFrame:
    """``items, names``: the rules' tokens by name, in order."""
    named = spark.createDataFrame(list(enumerate(tokens.names)), "item int, name string")
    return rules.select("items", F.explode("items").alias("item")).join(named, "item").groupBy("items").agg(
        F.array_sort(F.collect_list("name")).alias("names"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
               min_support: float = 0.005, min_confidence: float = 0.6) -> DataFrame:
    """Per page: ``id_col, host, path, rule, verdict, mined``. A host rule decides if one
    fits; else the URL is blocked when a mined rule fits, else allowed. ``labels(doc_id,
    quality, toxic)`` label the page of the same id: bad if toxic or of quality 0; labels
    that are null or repeat count once as bad if any is. A null URL has empty parts and
    is allowed."""
    ids = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"))
    urls = stage(parsed(ids), "urls")
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page")).agg(
        F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    marked = ids.join(bad, "page").groupBy("url").agg(F.max("bad").alias("bad")).join(urls, "url").select("tokens", "bad")
    tokens, rules = rule_table(marked, min_support, min_confidence)
    found = matches(urls, tokens, rules)
    judged = urls.select("url", "host", "path").join(found, "url", "left")
    fixed = host_rule(F.col("host"), F.col("path"))
    mined = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    judged = judged.withColumn("fixed", fixed).select(
        "url", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", mined).alias("verdict"), "mined")
    out = ids.join(judged, "url", "left")
    return out.select(F.col("page").alias(id_col), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                      "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "mined")
