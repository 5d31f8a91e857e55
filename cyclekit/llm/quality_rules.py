"""Quality rules on documents, and on hosts by the rates at which their documents fail.

``text_measures`` counts words, symbols, repeated lines and repeated 5-word windows of
whole texts in Arrow batches. ``host_verdicts`` aggregates failures by host (partial
aggregation, so a host with a third of all documents is one row a task), fits a beta
prior to the hosts' rates by moments, and shrinks each host's rate towards it: a host
with few documents keeps the prior's rate, one with many its own. The verdicts are
joined back to the documents; the join moves measures, never texts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import stage

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MIN_STRENGTH = 4.0      # the prior weighs as much as this many documents at least
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return run[off[1:]] - run[off[:-1]]


def _repeat_words(h: np.ndarray, k: int = X.SHINGLE) -> int:
    """Words that lie in a k-word window found twice or more."""
    wide = X.window_hashes(h, k)
    if len(wide) < 2:
        return 0
    order = np.argsort(wide, kind="stable")
    same = wide[order][1:] == wide[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(wide), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measure(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for part in X.slices(batch, column):
        w = X.words(part.column(column))
        lead = (w.buf & 0xC0) != 0x80
        h = X.word_hashes(w)
        n = part.num_rows
        # lines: bytes between line feeds; those with a word, by hash within their text
        feed = np.flatnonzero(w.buf == 10)
        begin = np.unique(np.concatenate([w.off[:-1], feed + 1]))
        begin = begin[begin < len(w.buf)]
        stop = np.append(begin[1:], len(w.buf))
        stop = stop - (w.buf[stop - 1] == 10) if len(begin) else stop
        owner = np.searchsorted(w.off, begin, side="right") - 1
        wordy = np.concatenate([[0], np.cumsum(~w.space)])
        has = wordy[stop] > wordy[begin]
        lh, owner = X.span_hashes(w.buf, begin[has], stop[has]), owner[has]
        order = np.lexsort((lh, owner))
        again = (lh[order][1:] == lh[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        yield part, {
            "n_words": np.diff(w.first), "word_chars": _count(lead & ~w.space, w.off),
            "n_symbols": _count(_SYMBOL[w.buf], w.off),
            "n_dup_lines": np.bincount(owner[order][1:][again], minlength=n),
            "n_repeat_words": np.array([_repeat_words(h[a:b]) for a, b in zip(w.first[:-1], w.first[1:])], np.int64)}


def text_measures(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns and the measures (long). Null and empty texts measure 0."""
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    d = docs.select(*own) if text_col in keep else docs.select(*own, F.col(f"`{text_col}`").cast("string").alias("text"))
    source = f"k{keep.index(text_col)}" if text_col in keep else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in _measure(batch, source):
                cols = [part.column(f"k{i}") for i in range(len(keep))] + [pa.array(m[c], pa.int64()) for c in MEASURES]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"k{i}" for i in range(len(keep))), *(f"m{i}" for i in range(len(MEASURES)))])

    schema = ", ".join([*(f"k{i} {d.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))),
                        *(f"m{i} long" for i in range(len(MEASURES)))])
    done = d.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"m{i}").alias(m) for i, m in enumerate(MEASURES)])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """Rules counted against a host, on the measures."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > 3,
        "word_length": (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def beta_prior(hosts: DataFrame, fails: str, total: str) -> tuple[float, float]:
    """(a, b) of the beta distribution whose beta-binomial fits the hosts' rates by weighted
    moments. Hosts that differ no more than chance give a strong prior (strength 1e6);
    the strength is at least MIN_STRENGTH documents. Without hosts: (1, 1)."""
    k, n, f, inverse = hosts.agg(F.count("*"), F.sum(total), F.sum(fails), F.sum(1 / F.col(total))).first()
    if not k:
        return 1.0, 1.0
    mean = f / n
    gap = F.col(fails) / F.col(total) - F.lit(mean)
    spread = hosts.agg(F.sum(F.col(total) * gap * gap)).first()[0] * k / (max(k - 1, 1) * n)
    noise = mean * (1 - mean)
    extra = spread - noise * inverse / k
    strength = min(1e6, max(MIN_STRENGTH, (noise - spread) / extra)) if extra > 0 else 1e6
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measures: DataFrame, host_col: str, max_rate: float = 0.5) -> DataFrame:
    """One row a host: ``host_col, docs, fails_<rule>, rate_<rule>, host_rejected``. A host is
    rejected when the shrunk failure rate of any rule is above ``max_rate``. Rows without
    a host (null) take no part."""
    rules = rule_failures()
    hosts = stage(measures.where(F.col(f"`{host_col}`").isNotNull()).groupBy(host_col).agg(
        F.count("*").alias("docs"), *[F.sum(c.cast("long")).alias(f"fails_{r}") for r, c in rules.items()]), "hosts")
    rejected = F.lit(False)
    for r in rules:
        a, b = beta_prior(hosts, f"fails_{r}", "docs")
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)))
        rejected = rejected | (F.col(f"rate_{r}") > max_rate)
    return hosts.withColumn("host_rejected", rejected)


def judged(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
           max_rate: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col``, the measures, ``base_failed``, ``host_rejected`` and
    ``kept``. A document goes if it fails the base rules or its host is rejected. Null
    hosts are never rejected; null texts have no words and fail."""
    measured = stage(text_measures(docs, (id_col, host_col), text_col).select(
        F.col(id_col).alias("id"), F.col(host_col).alias("host"), *MEASURES), "measures")
    verdicts = host_verdicts(measured, "host", max_rate).select("host", "host_rejected")
    joined = measured.join(verdicts, "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.select(F.col("id").alias(id_col), *MEASURES, base_failed().alias("base_failed"),
                         rejected.alias("host_rejected"), (~base_failed() & ~rejected).alias("kept"))


def document_quality(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("host_rejected")


_RULE_SQL = {
    "base": "n_words < 10 OR 100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols * 10 > n_words",
    "dup_lines": "n_dup_lines > 3",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}


def _sql() -> str:
    rates = ", ".join(f"(sum(CASE WHEN {c} THEN 1 ELSE 0 END)) AS f_{r}" for r, c in _RULE_SQL.items())
    moments = ", ".join(f"sum(f_{r})::DOUBLE / sum(n) AS m_{r}" for r in _RULE_SQL)
    spreads = ", ".join(f"sum(n * (f_{r} / n::DOUBLE - m_{r}) ** 2) * count(*) / (greatest(count(*) - 1, 1) * sum(n)) AS s_{r}" for r in _RULE_SQL)
    strength = ", ".join(
        f"CASE WHEN s_{r} - m_{r} * (1 - m_{r}) * inv / k > 0 THEN least(1e6, greatest({MIN_STRENGTH}, (m_{r} * (1 - m_{r}) - s_{r}) "
        f"/ (s_{r} - m_{r} * (1 - m_{r}) * inv / k))) ELSE 1e6 END AS t_{r}, least(greatest(m_{r}, 1e-6), 1 - 1e-6) AS c_{r}" for r in _RULE_SQL)
    over = " OR ".join(f"(f_{r} + c_{r} * t_{r}) / (n + t_{r}) > 0.5" for r in _RULE_SQL)
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM d, unnest(string_split(t, chr(10))) AS u(l)
    WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
  m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
  h AS (SELECT source, count(*) AS n, {rates} FROM m WHERE source IS NOT NULL GROUP BY source),
  p AS (SELECT count(*) AS k, sum(1 / n::DOUBLE) AS inv, {moments} FROM h),
  q AS (SELECT any_value(k) AS k, any_value(inv) AS inv, {", ".join(f"any_value(m_{r}) AS m_{r}" for r in _RULE_SQL)}, {spreads} FROM h, p),
  b AS (SELECT {strength} FROM q),
  v AS (SELECT source, {over} AS rejected FROM h, b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULE_SQL["base"]} AS base_failed,
  NOT ({_RULE_SQL["base"]}) AND NOT coalesce(rejected, false) AS kept FROM m LEFT JOIN v USING (source)"""


SQL = _sql()
