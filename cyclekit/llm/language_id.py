"""Language identification by Bayesian evidence fusion.

Text: a naive Bayes model over hashed byte trigrams, trained by grouped sums over all
labelled texts. Markup: the declared language. Address: the host's last label and the
path's first part. Host: the languages of a host's other pages, smoothed towards its
domain's, that towards the suffix's, and that towards all pages'.

A first pass labels every row by its text alone. Grouped aggregation over these labels
gives how often each declared value and address part goes with each language, and the
counts behind the priors; a row's own label is taken out of its host's counts. The second
pass adds the log evidence. Every label is a language, however rare. What leaves the
executors is the text model (the non-zero gram counts of each language, ``BUCKETS`` at
most) and the total of each language: both grow with the languages, not with the corpus."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import stage

BUCKETS = 1 << 14
EVIDENCE = 50.0        # a text counts as this many independent trigrams at most (they overlap)
HELD = 256             # languages whose counts a task holds at once (128 KB each)
STRENGTH = 5.0         # pseudo-rows with which each level is smoothed towards the next


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram that lies in one text, how many each text has)."""
    n = len(buf)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    b = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    inside = np.ones(n, bool)
    for edge in (1, 2):
        at = off[1:] - edge
        inside[at[at >= 0]] = False
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    run = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside[:-2]], run[off[1:]] - run[off[:-1]]


@dataclass(frozen=True)
class TextModel:
    """Log probabilities by bucket: of the buckets that a language has, and of any other."""
    buckets: list[np.ndarray]
    values: list[np.ndarray]
    other: list[float]

    def row(self, k: int) -> np.ndarray:
        out = np.full(BUCKETS, self.other[k], np.float32)
        out[self.buckets[k]] = self.values[k]
        return out


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, bucket, grams) of (lang, text) rows; bucket -1 counts the label's texts."""
    sums: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1, pa.int32()), pa.array(c[at])], names=["lang", "bucket", "n"])
        sums.clear()
    for batch in batches:
        for part in X.slices(batch, "text", 4 * X.SLICE_BYTES):
            buf, off = X.text_buffer(part.column("text"))
            bucket, n = _grams(buf, off)
            labels = part.column("lang").dictionary_encode()
            of = labels.indices.to_numpy()
            few = len(labels.dictionary) <= 1 << 16          # 16-bit keys are sorted in linear time
            order = np.argsort(np.repeat(of.astype(np.uint16) if few else of, n), kind="stable")
            ends = np.cumsum(np.bincount(of, weights=n, minlength=len(labels.dictionary))).astype(np.int64)
            texts = np.bincount(of, minlength=len(labels.dictionary))
            lo = 0
            for i, lang in enumerate(labels.dictionary.to_pylist()):
                if lang not in sums:
                    if len(sums) >= HELD:
                        yield from flush()
                    sums[lang] = np.zeros(BUCKETS + 1, np.int64)
                sums[lang][1:] += np.bincount(bucket[order[lo:ends[i]]], minlength=BUCKETS)
                sums[lang][0] += texts[i]
                lo = ends[i]
    yield from flush()


def train_text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], TextModel]:
    """(languages, the commonest first, their text model) from all texts that have a
    label. Every label is kept. Without labelled texts the model has no language."""
    d = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and lang <> '' and text is not null")
    sums = d.mapInArrow(_gram_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language: at most BUCKETS + 1 places and counts
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).toArrow()
    rows = []
    for lang, c in zip(found.column("lang").to_pylist(), (v.values for v in found.column("c").combine_chunks()) if found.num_rows else ()):
        bucket, n = c.field("bucket").to_numpy(), c.field("n").to_numpy()
        rows.append((-int(n[bucket < 0].sum()), lang, bucket[bucket >= 0], n[bucket >= 0] + 0.5))
    rows.sort(key=lambda r: r[:2])
    size = [r[3].sum() + 0.5 * (BUCKETS - len(r[3])) for r in rows]
    return [r[1] for r in rows], TextModel([r[2].astype(np.uint16) for r in rows], [np.log(r[3] / t).astype(np.float32) for r, t in zip(rows, size)],
                                           [float(np.log(0.5 / t)) for t in size])


def _scored(size: int, model: TextModel, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text", 2 * X.SLICE_BYTES):
                buf, off = X.text_buffer(part.column("text"))
                bucket, n = _grams(buf, off)
                rows = np.zeros((part.num_rows, size))
                full = np.flatnonzero(n)
                if len(full):
                    first = (np.cumsum(n) - n)[full]
                    for k in range(size):
                        rows[full, k] = np.add.reduceat(model.row(k)[bucket], first, dtype=np.float64) / n[full] * np.minimum(n[full], EVIDENCE)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * size, pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists], names=[*keep, "ll"])
    return run


def _best(scores: Column) -> Column:
    """0-based place of the greatest score, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def identify(rows: DataFrame, langs: list[str], model: TextModel) -> DataFrame:
    """``rows(text, declared, address, host, domain, suffix, ...)`` -> its other columns with
    ``text_lang``, ``language``, ``confidence``. Any evidence may be null and is then left
    out; a row without text, markup, address and host gets the commonest language. Ties
    go to the first (commonest) language. Without languages all three are null."""
    evidence = ["declared", "address", "host", "domain", "suffix"]
    other = [c for c in rows.columns if c not in {"text", *evidence}]
    if not langs:
        none = F.lit(None)
        return rows.select(*other, none.cast("string").alias("text_lang"), none.cast("string").alias("language"), none.cast("double").alias("confidence"))
    keep = [*other, *evidence]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "ll array<double>"])
    scored = rows.select(*keep, "text").mapInArrow(_scored(len(langs), model, keep), schema)
    size, names = len(langs), F.array(*[F.lit(v) for v in langs])
    scored = stage(scored.withColumn("first", _best(F.col("ll"))), "scored")

    def counts(by: str, above: str | None = None) -> DataFrame:
        """Rows of each language under the key, as one array, and the key's next level. A key
        can stand with several (a page's host is also a source): its rows are summed, and
        the level is that of rows that have a suffix, if any."""
        keys = dict.fromkeys([by, above, "suffix"]) if above else [by]
        n = scored.where(F.col(by).isNotNull()).groupBy(*keys, "first").agg(F.count("*").cast("double").alias("n"))
        level = F.struct(F.col("suffix").isNotNull().alias("known"), F.col(above).alias("above")) if above else F.lit(None)
        n = n.withColumn("level", level).groupBy(by, "first").agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        n = n.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("m"), F.max("level").alias("level"))
        c = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        return n.select(by, c.alias("c"), *([F.col("level.above").alias(above)] if above else []))

    totals = dict(scored.groupBy("first").count().collect())
    every = sum(totals.values())
    whole = F.array(*[F.lit((totals.get(i, 0) + 1.0) / (every + size)) for i in range(size)])
    seen = F.array(*[F.lit(totals.get(i, 0) + 2.0) for i in range(size)])

    def smoothed(c: Column, base: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(c, base, lambda x, p: (x + STRENGTH * p) / (n + STRENGTH))

    suffixes = counts("suffix").select("suffix", smoothed(F.col("c"), whole).alias("ps"))
    domains = counts("domain", "suffix").join(suffixes, "suffix", "left").select(
        "domain", smoothed(F.col("c"), F.coalesce("ps", whole)).alias("pd"))
    hosts = counts("host", "domain").join(domains, "domain", "left").select(
        "host", F.col("c").alias("hc"), F.coalesce("pd", whole).alias("pd"))

    def likelihood(by: str, out: str) -> DataFrame:
        """log P(value | language) for each value of the column, add-one smoothed."""
        c = counts(by)
        return c.select(by, F.zip_with("c", seen, lambda n, t: F.log((n + F.lit(1.0)) / t)).alias(out))

    zero = F.array_repeat(F.lit(0.0), size)
    d = (scored.join(likelihood("declared", "ld"), "declared", "left").join(likelihood("address", "la"), "address", "left")
         .join(hosts, "host", "left"))
    own = F.zip_with("hc", F.sequence(F.lit(0), F.lit(size - 1)), lambda c, i: F.greatest(F.lit(0.0), c - F.when(i == F.col("first"), 1.0).otherwise(0.0)))
    prior = F.coalesce(smoothed(own, F.col("pd")), whole)
    score = F.zip_with(F.zip_with("ll", F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b),
                       F.zip_with(F.coalesce("ld", zero), F.coalesce("la", zero), lambda a, b: a + b), lambda a, b: a + b)
    d = d.withColumn("score", score)
    top = F.array_max("score")
    sure = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return d.select(*other, F.get(names, F.col("first")).alias("text_lang"), F.get(names, _best(F.col("score"))).alias("language"), sure.alias("confidence"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Text without markup, declared language, address part, host, domain and suffix of a page."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))
    part = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    some = lambda c: F.when(c != "", c)
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), some(declared).alias("declared"),
                        some(part).alias("address"), some(host).alias("host"), some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
                        some(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents have no markup or address: their language column is what is declared, their
    source is the host."""
    source, none = F.col("source").cast("string"), F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("declared"), none.alias("address"), source.alias("host"), source.alias("domain"), none.alias("suffix"))


def languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page and per document: doc_id or page_id, text_lang, language, confidence."""
    langs, model = train_text_model(docs)
    return identify(page_evidence(pages).unionAll(document_evidence(docs)), langs, model)
