"""Hard-negative mining over an inverted multi-index with certified windows.

Index: a vector's two halves are quantised by a codebook each, so a vector lies in one of
K x K cells. The codebooks are fitted on a bounded sample (``SAMPLE`` rows, the least by
hash of the id); every row is indexed. A half's centroid and the radius of its members
bound the half's inner product with a query, so two half bounds add up to a bound for all
rows of a cell. Large cells are stored as several blocks of about ``BLOCK_ROWS`` rows.

Search: per query the multi-sequence heap visits cells by falling bound. Four passes over
the blocks, whatever the data: the first cells give each anchor five positives and so a
floor; all further cells whose bound reaches the floor certify them. The first cells again
give negatives in each positive's window; all further cells whose bound reaches the
least floor of the windows certify those. A cell that is left out cannot hold a row that
would be returned. Queries are packed in groups, and a group is joined with the blocks of
the cells that its members visit, so a task sees one block and one group at a time."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_stage, stage

SAMPLE = 20_000          # rows that the codebooks are fitted on, at most
ROWS_PER_CELL = 256      # aimed at; at most MAX_CODES ** 2 cells
MAX_CODES = 256
BLOCK_ROWS = 2048
GROUP = 512              # queries of a group
FIRST_ROWS = 2048        # rows of the cells that the first pass visits, at least
NONE = -(1 << 62)        # below every score


def quantised(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """``id, label, vec``: components ``floor(scale * x)``. Rows with a null id, label or vector
    or any null or non-finite component take no part."""
    x = F.col(f"`{vec_col}`")
    d = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"), x.alias("x"))
    whole = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    d = d.where("id is not null and label is not null and x is not null").where(whole)
    return d.select("id", "label", F.transform("x", lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long")).alias("vec"))


def _codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from evenly spread rows; fewer codes if there are fewer distinct points."""
    distinct = np.unique(points, axis=0)
    codes = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds):
        near = _nearest(points, codes)[0]
        n = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, points)
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
    return codes


def _nearest(points: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest code, distance to it) of each point."""
    far = (codes * codes).sum(axis=1) - 2 * points @ codes.T
    near = far.argmin(axis=1)
    return near, np.sqrt(((points - codes[near]) ** 2).sum(axis=1))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter vectors are filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel(), pa.int64()))


def _assigned(books: tuple[np.ndarray, np.ndarray], width: int):
    half, k = width // 2, len(books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), width)
            (a, da), (b, db) = (_nearest(p.astype(float), c) for p, c in zip((x[:, :half], x[:, half:]), books))
            yield _rows({"id": batch.column("id"), "label": batch.column("label"), "vec": _lists(x), "cell": pa.array(a * k + b, pa.int32()),
                         "far1": pa.array(da), "far2": pa.array(db)})
    return run


class Cells:
    """Bounds of the cells: the two codebooks, their radii over all rows, and rows a cell."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], cells: list):
        self.books, k = books, len(books[1])
        self.block_rows, self.first_rows = BLOCK_ROWS, FIRST_ROWS
        self.count = np.zeros(len(books[0]) * k, np.int64)
        self.radius = [np.zeros(len(c)) for c in books]
        for cell, n, far1, far2 in cells:
            self.count[cell] = n
            for radius, code, far in zip(self.radius, divmod(cell, k), (far1, far2)):
                radius[code] = max(radius[code], far)

    def blocks(self, cell: int) -> int:
        return -(-int(self.count[cell]) // self.block_rows)

    def visit(self, vec: np.ndarray, skip: int, floor: int | None) -> Iterator[int]:
        """Non-empty cells by falling bound, the first ``skip`` left out: those whose bound
        reaches ``floor``; without a floor, until FIRST_ROWS rows are seen."""
        half = self.books[0].shape[1]
        bounds, order = [], []
        for q, codes, radius in zip((vec[:half].astype(float), vec[half:].astype(float)), self.books, self.radius):
            bound = codes @ q + np.sqrt(q @ q) * radius
            bound += 1e-9 * (np.abs(bound) + np.abs(codes) @ np.abs(q)) + 1e-6       # rounding never lowers a bound
            order.append(np.argsort(-bound, kind="stable").tolist())
            bounds.append(bound[order[-1]].tolist())
        (one, two), k, seen, place = bounds, len(order[1]), 0, 0
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if floor is not None and -bound < floor:
                return
            if j + 1 < k:
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
            cell = order[0][i] * k + order[1][j]
            if self.count[cell]:
                place += 1
                if place > skip:
                    yield cell
                seen += int(self.count[cell])
                if floor is None and seen >= self.first_rows:
                    return


QUERY = "aid long, own long, label int, vec array<long>, skip int, floor long, high array<long>, low array<long>"


def _visits(cells: Cells, width: int):
    """Groups of queries -> one row a group and block: the members that visit its cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                m = members.values
                vecs = _matrix(m.field("vec"), width)
                who: dict[int, list[int]] = {}
                for i, (skip, floor) in enumerate(zip(m.field("skip").to_pylist(), m.field("floor").to_pylist())):
                    for cell in cells.visit(vecs[i], skip, floor):
                        who.setdefault(cell, []).append(i)
                keys = sorted(who)
                for lo in range(0, len(keys), 64):
                    cell, chunk, part = [], [], []
                    for c in keys[lo:lo + 64]:
                        for b in range(cells.blocks(c)):
                            cell.append(c)
                            chunk.append(b)
                            part.append(who[c])
                    off = np.concatenate([[0], np.cumsum([len(p) for p in part])])
                    taken = m.take(pa.array(np.concatenate(part).astype(np.int64)))
                    yield _rows({"cell": pa.array(cell, pa.int32()), "chunk": pa.array(chunk, pa.int32()),
                                 "members": pa.ListArray.from_arrays(pa.array(off, pa.int32()), taken)})
    return run


def _first(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` first by falling score, then id."""
    if len(score) > 4 * keep:
        least = -np.partition(-score, keep - 1)[keep - 1]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:keep]]
    return np.lexsort((ids, -score))[:keep]


def _scored(width: int, keep: int, exact: type):
    """Joined rows of a group and a block -> the first rows of each member in the block, above
    its floors: of its own label (no windows), or of other labels for each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, rows in zip(batch.column("members"), batch.column("rows")):
                m, r = members.values, rows.values
                ids, labels = r.field("id").to_numpy(), r.field("label").to_numpy()
                x = _matrix(r.field("vec"), width)
                _, single = np.unique(np.column_stack([ids, labels, x]), axis=0, return_index=True)      # repeated rows count once
                ids, labels, x = ids[single], labels[single], x[single]
                q = _matrix(m.field("vec"), width)
                scores = (q.astype(exact) @ x.astype(exact).T).astype(np.int64)
                out: dict[str, list] = {"aid": [], "place": [], "id": [], "score": []}

                def put(aid: int, place: int, some: np.ndarray, s: np.ndarray) -> None:
                    some = some[_first(s[some], ids[some], keep)]
                    out["aid"] += [aid] * len(some)
                    out["place"] += [place] * len(some)
                    out["id"] += ids[some].tolist()
                    out["score"] += s[some].tolist()

                fields = (m.field(f).to_pylist() for f in ("aid", "own", "label", "floor", "high", "low"))
                for s, (aid, own, label, floor, high, low) in zip(scores, zip(*fields)):
                    other = ids != own
                    if not high:
                        put(aid, 0, np.flatnonzero(other & (labels == label) & (s >= (NONE if floor is None else floor))), s)
                    for place, (top, least) in enumerate(zip(high, low)):
                        put(aid, place, np.flatnonzero(other & (labels != label) & (s <= top) & (s >= least)), s)
                yield _rows({c: pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in out.items()})
    return run


class MultiIndex:
    """Blocks of all rows by cell, and the cells' bounds."""

    def __init__(self, rows: DataFrame):
        rows = stage(rows, "vectors")
        n, width, top = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.n, self.width = n, max(2, width or 0)
        size = self.width * (top or 0) ** 2
        if size >= 1 << 62:
            raise ValueError("inner products of these vectors do not fit 64 bits")
        self.exact = np.float64 if size < 1 << 53 else np.int64          # both give exact sums
        if not n:
            return
        sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).toArrow().column("vec").combine_chunks()
        points = _matrix(sample, self.width).astype(float)
        k, half = int(min(MAX_CODES, max(2, np.ceil(np.sqrt(n / ROWS_PER_CELL))))), self.width // 2
        books = (_codebook(points[:, :half], k), _codebook(points[:, half:], k))
        placed = stage(rows.mapInArrow(_assigned(books, self.width), "id long, label int, vec array<long>, cell int, far1 double, far2 double"), "cells")
        delete_stage(rows)
        self.cells = Cells(books, [tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.max("far1"), F.max("far2")).collect()])
        sizes = rows.sparkSession.createDataFrame([(c, self.cells.blocks(c)) for c in np.flatnonzero(self.cells.count).tolist()], "cell int, parts int")
        chunk = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        # at most MAX_CODES ** 2 sizes; a block holds about BLOCK_ROWS rows
        self.blocks = stage(placed.join(F.broadcast(sizes), "cell").groupBy("cell", chunk.alias("chunk")).agg(
            F.collect_list(F.struct("id", "label", "vec")).alias("rows")), "blocks")
        delete_stage(placed)

    def opened(self, queries: DataFrame) -> DataFrame:
        """``queries(id, label, vec)`` numbered ``aid``, with ``skip``: cells of their first pass."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vecs = _matrix(batch.column("vec"), width) if batch.num_rows else ()
                n = [sum(1 for _ in cells.visit(v, 0, None)) for v in vecs]
                yield _rows({c: batch.column(c) for c in ("aid", "own", "label", "vec")} | {"skip": pa.array(n, pa.int32())})

        cells, width = self.cells, self.width
        return queries.select(F.monotonically_increasing_id().alias("aid"), F.col("id").alias("own"), "label", "vec").mapInArrow(
            run, "aid long, own long, label int, vec array<long>, skip int")

    def found(self, queries: DataFrame, keep: int) -> DataFrame:
        """One pass: ``queries`` (QUERY) -> aid, place, id, score. Blocks hold all vectors and must not
        be broadcast through the driver: their files are small, their rows are not."""
        groups = F.pmod(F.xxhash64("aid"), F.lit(max(1, -(-self.n // (100 * GROUP))))).alias("g")
        packed = queries.groupBy(groups).agg(F.collect_list(F.struct(*[f.split()[0] for f in QUERY.split(", ")])).alias("members")).select("members")
        members = "array<struct<" + ",".join(f.replace(" ", ":") for f in QUERY.split(", ")) + ">>"
        visits = packed.mapInArrow(_visits(self.cells, self.width), f"cell int, chunk int, members {members}")
        return visits.join(self.blocks.hint("merge"), ["cell", "chunk"]).select("members", "rows").mapInArrow(
            _scored(self.width, keep, self.exact), "aid long, place int, id long, score long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` first of each anchor and window, numbered ``rank``."""
    order = Window.partitionBy("aid", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """``rows(id, label, vec)`` and ``anchors`` (a part of them), vectors of integers ->
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first rows of the same label by falling inner product,
    then id; each positive's negatives the first rows of other labels whose score s has
    ``percent * p <= 100 * s <= 100 * p``, p the positive's. Rows with the anchor's own id
    never match it; rows that repeat wholly count once (repeated anchors too). Shorter
    vectors are filled with zeros. Products must fit 64 bits (else ValueError). No rows
    give no rows."""
    spark = rows.sparkSession
    index = MultiIndex(rows)
    if not index.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    empty = F.array().cast("array<long>")
    vec = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(index.width) - F.size("vec")))
    asked = stage(index.opened(anchors.select("id", "label", vec.alias("vec")).distinct()), "anchors")
    none = F.lit(None).cast("long")
    fields = [f.split()[0] for f in QUERY.split(", ")]
    start = asked.select("aid", "own", "label", "vec", F.lit(0).alias("skip"), none.alias("floor"), empty.alias("high"), empty.alias("low"))

    # positives: the first cells, then all that can still hold one of the first few
    seen = stage(index.found(start, positives), "found")
    last = _best(seen, positives).groupBy("aid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    more = asked.join(last, "aid", "left").select(
        "aid", "own", "label", "vec", "skip", F.when(F.col("n") >= positives, F.col("least")).otherwise(F.lit(NONE)).alias("floor"), empty.alias("high"), empty.alias("low"))
    chosen = stage(_best(seen.unionByName(index.found(more.select(fields), positives)), positives).select(
        "aid", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("p")), "positives")
    delete_stage(seen)

    # negatives: windows [percent of p, p]; a positive below zero has an empty one
    lowest = F.expr(f"(p * {percent} + 99) div 100")
    windows = chosen.where("p >= 0").groupBy("aid").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("p").alias("high"), lowest.alias("low")))).alias("w"))
    wide = asked.join(windows, "aid").withColumn("high", F.col("w.high")).withColumn("low", F.col("w.low"))
    seen = stage(index.found(wide.select("aid", "own", "label", "vec", F.lit(0).alias("skip"), none.alias("floor"), "high", "low"), negatives), "found")
    least = _best(seen, negatives).groupBy("aid", "place").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= negatives)
    floors = least.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("m"))
    raised = F.transform("low", lambda v, i: F.coalesce(F.try_element_at("m", i), v))
    more = wide.join(floors, "aid", "left").withColumn("low", raised).withColumn("floor", F.array_min("low"))
    negative = _best(seen.unionByName(index.found(more.select(fields), negatives)), negatives)
    out = chosen.join(negative.select("aid", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["aid", "place"])
    return out.join(asked.select("aid", F.col("own").alias("anchor_id")), "aid").select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")


def mined_embeddings(embeddings: DataFrame) -> DataFrame:
    """The stated query: labels of ids divisible by 7 are moved on by one modulo 10; anchors
    are the ids divisible by 100."""
    rows = quantised(embeddings, "vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  c AS (SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
  s AS (SELECT a.id AS anchor_id, b.id, any_value(a.label) = any_value(b.label) AS same, sum(a.x * b.x)::BIGINT AS score
    FROM c a JOIN c b ON a.i = b.i AND a.id <> b.id WHERE a.id % 100 = 0 GROUP BY a.id, b.id),
  p AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT * FROM (SELECT p.anchor_id, positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id)::INTEGER AS rank,
    s.id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score) WHERE rank <= 5"""
