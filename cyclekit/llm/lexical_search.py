"""Ranked lexical search by branch and bound over document FP-trees.

1. One pass over the texts restricts each document to the terms of the items, with their
   counts, and its length over all terms. Document counts, total length and document
   frequencies cover all documents.
2. A task takes blocks of restricted documents, puts their terms in frequency order (the
   commonest first) and builds an FP-tree of each block: documents with equal beginnings
   share a path, unary paths are one edge, and small neighbouring branches share a leaf. A
   node keeps the greatest count of every term, the least length factor m and the least
   id of its subtree.
3. The score of a term grows with its count and falls with m, so a node's maxima and
   minimum bound all its documents. Each item goes depth first into the branches of
   highest bound and leaves out those whose bound cannot enter its best k any more; the
   documents of a leaf are scored in full.
4. The best k of the tasks are merged, first within parts of each item's rows.

Items are a query set of checked size: they are taken in blocks of at most ``block_items``
items and ``block_bytes`` of text, one pass over the documents each. Terms are matched by
64-bit hashes."""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import stage

#: Fixed values of the ranking.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
K, WEIGHT, SCALE, TF, M = 10, 1000, 1_000_000_000, 1000, 8
BASE, SLOPE = 25, 75

LAST = (1 << 63) - 1              # stands for a null id: behind every other
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 2_000_000
LEAF = 32                         # documents that a leaf aims at
TREE_CELLS = 8_000_000            # nodes times terms of a tree, about
PARTS = 64                        # parts of an item's rows that are merged first

_IN_TERM = np.ones(256, bool)
_IN_TERM[:128] = [chr(b).isalnum() for b in range(128)]
_UPPER = dict(zip(range(65, 91), range(97, 123)))


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(_UPPER))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, first[i]:first[i + 1] those of text i). Bytes of a longer UTF-8
    sequence are term bytes, so byte runs are the maximal matches."""
    buf, off = X.text_buffer(texts)
    buf = X._LOWER[buf]
    inside = _IN_TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return X.span_hashes(buf, start, end), np.searchsorted(start, off)


def _restricted(known: np.ndarray, number: np.ndarray):
    """Rows (doc, text) -> (doc, n, terms, counts), terms by number; texts without a term are
    left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text", 4 * X.SLICE_BYTES):
                h, first = term_hashes(part.column("text"))
                n = np.diff(first)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, hit, side="right") - 1
                pair, count = np.unique(doc * max(len(known), 1) + number[at[hit]] if len(hit) else hit, return_counts=True)
                doc, term = np.divmod(pair, max(len(known), 1))
                off = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rows = pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(count, pa.int32()))], names=["doc", "n", "terms", "counts"])
                yield rows.filter(pa.array(n > 0))
    return run


class Tree:
    """FP-tree of a block: ``order`` lists its documents by term vector, a node is a range of it.
    Term places ascend within a document."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, off: np.ndarray, term: np.ndarray, count: np.ndarray, width: int):
        keys = [term[a:b].astype(">u4").tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        shared = [0] * (len(order) + 1)                   # terms that a document shares with the one before
        for i in range(1, len(order)):
            a, b = keys[order[i - 1]], keys[order[i]]
            n = min(len(a), len(b))
            if a[:n] == b[:n]:
                shared[i] = n // 4
            else:
                differ = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
                shared[i] = int(differ.argmax()) // 4
        order = np.array(order, np.int64)
        self.ids, self.m = ids[order], m[order]
        size = np.diff(off)[order]
        self.off = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(off[:-1][order] - self.off[:-1], size) + np.arange(self.off[-1])
        self.term, self.count = term[take], count[take]
        leaf = max(LEAF, len(order) * max(width, 1) * 2 // TREE_CELLS)

        # nodes as (first, behind last) with their children; a branch is where fewer terms are shared
        shared = np.array(shared)
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        todo = [(0, len(order), -1)]
        while todo:
            lo, hi, up = todo.pop()
            me = len(self.span)
            self.span.append((lo, hi))
            self.children.append([])
            if up >= 0:
                self.children[up].append(me)
            if hi - lo > leaf:
                inner = shared[lo + 1:hi]
                cuts = [lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi]
                if int(inner.min()) == int(inner.max()):                     # nothing shared further down, or all equal
                    cuts = [*range(lo, hi, leaf), hi]
                begin = cuts[0]
                for a, b in zip(cuts[1:], [*cuts[2:], None]):
                    # neighbouring branches stay together while they fit a leaf
                    if b is None or b - begin > leaf:
                        todo.append((begin, a, me))
                        begin = a
        self._measure(width)

    def _measure(self, width: int) -> None:
        n = len(self.span)
        self.high = np.zeros((n, width), np.int32)
        self.low = np.zeros(n, np.int64)
        self.first = np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):                    # children stand behind their parent
            lo, hi = self.span[i]
            if self.children[i]:
                self.high[i] = self.high[self.children[i]].max(axis=0)
            else:
                a, b = self.off[lo], self.off[hi]
                np.maximum.at(self.high[i], self.term[a:b], self.count[a:b])
            self.low[i], self.first[i] = self.m[lo:hi].min(), self.ids[lo:hi].min()

    def search(self, places: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The first k of ``best`` and the documents, as (-score, id)."""
        tf = self.high[:, places].astype(np.int64)
        bound = ((SCALE * tf) // (TF * tf + M * self.low[:, None])) @ weight
        bounds, first = bound.tolist(), self.first.tolist()
        column = np.full(self.high.shape[1], -1)
        column[places] = np.arange(len(places))
        todo = [0]
        while todo:
            node = todo.pop()
            if bounds[node] <= 0 or len(best) == k and (-bounds[node], first[node]) >= best[-1]:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bounds.__getitem__)
                continue
            lo, hi = self.span[node]
            a, b = int(self.off[lo]), int(self.off[hi])
            at = column[self.term[a:b]]
            hit = np.flatnonzero(at >= 0)
            doc = np.searchsorted(self.off[lo:hi + 1], a + hit, side="right") - 1
            tf = self.count[a + hit].astype(np.int64)
            part = weight[at[hit]] * ((SCALE * tf) // (TF * tf + M * self.m[lo:hi][doc]))
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, doc, part)
            some = np.flatnonzero(score >= (-best[-1][0] if len(best) == k else 1))
            best = sorted([*best, *zip((-score[some]).tolist(), self.ids[lo:hi][some].tolist())])[:k]
        return best


def _searched(items: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, width: int, docs: int, length: int, k: int):
    """Restricted documents -> (item, doc, score): the task's best k of each item."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of about BLOCK_DOCS documents and BLOCK_POSTINGS postings together."""
        held, rows, size = [], 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = min(batch.num_rows, lo + BLOCK_DOCS - rows, max(lo + 1, int(np.searchsorted(ends, base + BLOCK_POSTINGS - size))))
                held.append(batch.slice(lo, hi - lo))
                rows, size, lo = rows + hi - lo, size + int(ends[hi - 1] - base), hi
                if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, rows, size = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for b in blocks(batches):
            ids = b.column("doc").fill_null(LAST).to_numpy()
            m = BASE + (SLOPE * b.column("n").to_numpy() * docs) // length
            size = b.column("terms").value_lengths().to_numpy()
            term = place[b.column("terms").flatten().to_numpy()]
            order = np.lexsort((term, np.repeat(np.arange(b.num_rows), size)))       # terms in frequency order in each document
            tree = Tree(ids, m, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), term[order],
                        b.column("counts").flatten().to_numpy()[order], width)
            for i, (places, weight) in enumerate(items):
                best[i] = tree.search(places, weight, best[i], k)
        flat = [(i, d, -s) for i, each in enumerate(best) for s, d in each]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.int32()), pa.array([None if f[1] == LAST else f[1] for f in flat], pa.int64()),
             pa.array([f[2] for f in flat], pa.int64())], names=["item", "doc", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block_items: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """``item_col, rank, id_col, score``: each item's k documents of highest score above 0, equal
    scores by ascending id (null ids last). A document that repeats is ranked as often as it
    stands in the table; items that repeat with the same id and text are searched once. Null
    or termless texts and items have no rows. Other columns are not read."""
    spark = docs.sparkSession
    wanted = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")
                          ).where("text is not null").distinct()
    count, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-size // block_bytes))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    out = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        found = _block(d, [(r[0], Counter(terms(r[1]))) for r in rows], k)
        if found is not None:
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "item long, rank int, doc long, score long")
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _block(docs: DataFrame, items: list[tuple[int | None, Counter]], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, c in items for t in c})
    if not vocabulary:
        return None
    h, _ = term_hashes(pa.array(vocabulary))
    number = np.argsort(h, kind="stable")
    known = h[number]
    plain = stage(docs.mapInArrow(_restricted(known, number), "doc long, n long, terms array<int>, counts array<int>"), "restricted")
    n_docs, length = plain.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in plain.select(F.explode("terms").alias("t")).groupBy("t").count().collect():       # at most the items' terms
        df[t] = n
    weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    # frequency order: the commonest term is place 0; terms that no document has are left out
    common = np.argsort(-df, kind="stable")
    place = np.empty(len(df), np.int64)
    place[common] = np.arange(len(df))
    at = {t: i for i, t in enumerate(vocabulary)}
    asked = []
    for _, c in items:
        own = [(at[t], n) for t, n in c.items() if df[at[t]]]
        asked.append((place[[t for t, _ in own]] if own else np.zeros(0, np.int64), np.array([n * weight[t] for t, n in own], np.int64)))
    found = plain.mapInArrow(_searched(asked, place, int((df > 0).sum()), n_docs, length, k), "item int, doc long, score long")
    first = Window.partitionBy("item", "part").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    merged = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "number int, own long")      # the block's items
    return merged.join(names, F.col("item") == F.col("number")).select(F.col("own").alias("item"), "rank", "doc", "score")


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL),
  t AS (SELECT r, term, count(*) AS tf FROM d, unnest(w) AS u(term) GROUP BY r, term),
  s AS (SELECT count(*) AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
  f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
  b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
  i AS (SELECT item_id, text, term, count(*) AS c FROM (SELECT item_id, text,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM b) GROUP BY item_id, text, term),
  w AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
  m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(w) * N) // L) AS m FROM d, s WHERE len(w) > 0),
  g AS (SELECT item_id, i.text, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM i JOIN w USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY item_id, i.text, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM g WHERE score > 0) WHERE rank <= 10"""
