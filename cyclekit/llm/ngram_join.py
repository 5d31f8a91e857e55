"""N-gram Jaccard self-join through parity sketches.

Sets are the distinct word 5-grams of a text. Two sets link when
``intersection / union >= threshold``; then their symmetric difference has at most
``(a + b) * (1 - t) / (1 + t)`` members (``(a + b) / 9`` for 0.8).

1. Every set gets two sketches made by XOR. The *bit sketch* flips one bit per
   token, so the Hamming distance of two sketches never exceeds the symmetric
   difference. The *lane sketch* XORs each token's 64-bit hash into one of K lanes,
   so the number of unequal lanes never exceeds it either.
2. Pigeonhole join per size band (bands of ``a + b``, so both sides use the same K): a
   linked pair with difference d agrees in at least ``max(filled lanes) - d`` filled
   lanes. Each set therefore posts only the first ``d + 1`` of its filled lanes in a
   fixed order (most tokens first, which makes equal lanes of unrelated texts
   rare); two linked sets always share a posting. Sets with too few filled lanes
   also post to one reserve key of the band.
3. Tokens found in many texts (shared passages) go to lanes of their own, which come
   last in the order. Any assignment of tokens to lanes is exact, so this list only
   steers speed. A bucket of ordinary lanes then holds less than ``heavy_share`` of
   the sets; buckets of heavy lanes are salted and pre-aggregated.
4. Instead of all pairs of a bucket, each member is compared with the bucket's
   best-connected member. Verified links give components. Only buckets whose members
   are still in different components compare the remaining cross-component pairs,
   in bounded blocks. No link that could join two components is left untested, so
   components are exact.
5. Candidates pass the bit-sketch bound first, then exact set intersection.

Identities are 64-bit hashes of whole sets; shingles are 64-bit hashes."""
from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import delete_stage, stage
from .graph import components

_U = np.uint64
BAND_RATIO = 3
BLOCK = 512


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, sorted distinct shingle hashes) of each row of ``(id, text)``."""
    for part in X.slices(batch, "text"):
        w = X.words(part.column("text"), lower=True)
        ids = part.column("id").to_pylist()
        for i, s in zip(ids, X.text_shingles(X.word_hashes(w), w.first, k)):
            yield i, np.unique(s)


def _identity(s: np.ndarray) -> int:
    m = X.mix(s + _U(0x51ED270B))
    both = np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(m) if len(m) else 0], np.uint64)
    return int(X.mix(X.mix(both[:1]) + both[1:] * _U(3) + _U(len(s)))[0].view(np.int64))


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity sketch: 2 to 4 bits a token (64 at least, a power of two), one flipped per token."""
    bits = max(64, 1 << int(2 * len(s) - 1).bit_length())
    flips = np.bincount((X.mix(s + _U(0x2545F491)) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """XOR a sketch down to fewer 64-bit words; keeps the lower bound."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, n) ^ _fold(y, n)).sum())


class Lanes:
    """Lane postings of a set for a Jaccard threshold t."""

    def __init__(self, threshold: Fraction, heavy: np.ndarray):
        self.t = threshold
        self.slack = (1 - threshold) / (1 + threshold)
        self.heavy = np.sort(heavy.astype(np.uint64))
        self.edges = [2]
        while self.edges[-1] < 1 << 50:
            self.edges.append(self.edges[-1] * BAND_RATIO)

    def most(self, total: int) -> int:
        """Largest symmetric difference of a linked pair with a + b = total."""
        return int(total * self.slack)

    def bands(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(band, lanes, largest difference for this set) for each band a partner may be in."""
        low, high = n + -int(-n * self.t // 1), n + int(n / self.t)
        for t, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            if a <= high and low < b:
                yield t, int(1.25 * (self.most(b - 1) + 1)) + 4, self.most(min(b - 1, high))

    def post(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, whether the key's bucket may be large)."""
        keys, large = [], []
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, s), len(self.heavy) - 1)
            is_heavy = self.heavy[at] == s
        else:
            is_heavy = np.zeros(len(s), bool)
        h = X.mix(s + _U(0x1B873593))
        value = X.mix(h + _U(0x7FEB352D))
        for band, k, d in self.bands(len(s)):
            lane = (((h >> _U(32)) * _U(k)) >> _U(32)).astype(np.int64) + k * is_heavy
            order = np.argsort(lane, kind="stable")
            ranked = lane[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            count = np.diff(np.concatenate([first, [len(s)]]))
            xor = np.bitwise_xor.reduceat(value[order], first)
            where = ranked[first]
            key = X.mix(xor + X.mix(where.astype(np.uint64) * _U(131) + _U(band + 1)))
            weak = where >= k
            if len(key) > d + 1:
                keep = np.lexsort((key, -count, weak))[:d + 1]
                key, weak = key[keep], weak[keep]
            keys.append(key)
            large.append(weak)
            if len(where) <= d:
                keys.append(X.mix(np.array([band + 7_000_003], np.uint64)))
                large.append(np.ones(1, bool))
        return np.concatenate(keys), np.concatenate(large)


def _survey(k: int, share: float, chunk: int = 2_000_000):
    """Per text: id, set size, identity, bit sketch. Per chunk of texts: shingles that
    ``share / 2`` of the chunk's distinct sets (4 at least) hold, with their counts."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("sketch", pa.binary()),
                        ("shingle", pa.int64()), ("texts", pa.int64())])

    def rows(cols: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = np.empty(chunk, np.uint64), set(), 0

        def common() -> pa.RecordBatch:
            s = held[:total]
            s.sort()                             # in place; a run of ``least`` equal values is a common shingle
            least = max(4, math.ceil(share / 2 * len(seen)))
            u = np.unique(s[least - 1:][s[least - 1:] == s[:max(0, total - least + 1)]])
            c = np.searchsorted(s, u, side="right") - np.searchsorted(s, u)
            return rows({"shingle": u.view(np.int64), "texts": c}, len(u))

        for batch in batches:
            out = {"id": [], "n": [], "sid": [], "sketch": []}
            for i, s in _sets(batch, k):
                sid = _identity(s)
                for name, v in zip(out, (i, len(s), sid, bit_sketch(s) if len(s) else b"")):
                    out[name].append(v)
                if len(s) and sid not in seen:
                    if total + len(s) > chunk and total:
                        yield common()
                        seen, total = set(), 0
                    if len(s) > len(held):
                        held = np.empty(len(s), np.uint64)
                    held[total:total + len(s)] = s
                    seen.add(sid)
                    total += len(s)
            yield rows(out, len(out["id"]))
        if total:
            yield common()

    return run, "id long, n long, sid long, sketch binary, shingle long, texts long"


def _postings(k: int, threshold: Fraction, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, seen = Lanes(threshold, heavy), set()
        for batch in batches:
            sids, keys, salts, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts)),
                     pa.array(np.concatenate(sids))], names=["key", "salt", "sid"])

            for i, s in _sets(batch, k):
                if i is None or not len(s):
                    continue
                sid = _identity(s)
                if sid in seen:
                    continue
                seen.add(sid)
                if len(seen) > 500_000:
                    seen.clear()
                key, large = lanes.post(s)
                keys.append(key)
                salts.append(np.where(large, 1 + sid % 64, 0).astype(np.int32))
                sids.append(np.full(len(key), sid, np.int64))
                held += len(key)
                if held > 200_000:
                    yield out()
                    sids, keys, salts, held = [], [], [], 0
            if held:
                yield out()

    return run, "key long, salt int, sid long"


def _near(slack: Fraction, threshold: Fraction):
    """Keep pairs (a, b) that sizes and bit sketches allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = np.minimum(na, nb) * threshold.denominator >= np.maximum(na, nb) * threshold.numerator
            sa, sb = batch.column("sa"), batch.column("sb")
            for i in np.flatnonzero(ok).tolist():
                ok[i] = sketch_distance(sa[i].as_py(), sb[i].as_py()) <= int((int(na[i]) + int(nb[i])) * slack)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))
    return run


def _blocks(slack: Fraction, threshold: Fraction):
    """Rows of one (key, i, j) come together: compare the two blocks' members of different
    components by size and bit sketch, and give the pairs that may link."""
    def compare(g: dict) -> tuple[np.ndarray, np.ndarray]:
        n, root, sid, side = (np.array(g[c]) for c in ("n", "root", "sid", "side"))
        a, b = [], []
        words = [max(1, len(s) // 8) for s in g["sketch"]]
        sk = [np.frombuffer(s, np.uint64) for s in g["sketch"]]
        folded: dict[int, np.ndarray] = {}
        for x in range(len(n)):
            y = np.flatnonzero((root > root[x]) & ((side != side[x]) | (side == 2))
                               & (np.minimum(n, n[x]) * threshold.denominator >= np.maximum(n, n[x]) * threshold.numerator))
            for w in {min(words[x], words[i]) for i in y.tolist()}:
                z = np.array([i for i in y.tolist() if min(words[x], words[i]) == w])
                if w not in folded:
                    folded[w] = np.stack([_fold(s, w) if len(s) >= w else np.zeros(w, np.uint64) for s in sk])
                far = np.bitwise_count(folded[w][z] ^ folded[w][x]).sum(axis=1)
                z = z[far <= ((n[z] + n[x]) * slack.numerator) // slack.denominator]
                a += [sid[x]] * len(z)
                b += sid[z].tolist()
        return np.array(a, np.int64), np.array(b, np.int64)

    names = ("n", "root", "sid", "side", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("key", "i", "j", *names)}
            a, b = [], []
            for r in range(batch.num_rows):
                at = (cols["key"][r], cols["i"][r], cols["j"][r])
                if at != now:
                    if group:
                        x, y = compare(group)
                        a.append(x), b.append(y)
                    now, group = at, {c: [] for c in names}
                for c in names:
                    group[c].append(cols[c][r])
            if a:
                yield pa.RecordBatch.from_arrays([np.concatenate(a), np.concatenate(b)], names=["a", "b"])
        if group:
            x, y = compare(group)
            yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])
    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                ids, sids, sets = [], [], []
                for i, s in _sets(part, k):
                    ids.append(i), sids.append(_identity(s)), sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sids, pa.int64()), pa.array(sets, pa.binary())],
                    names=["id", "sid", "shingles"])
    return run, "id long, sid long, shingles binary"


def _linked(threshold: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                both = int((a[at] == b).sum())
                keep[i] = both * threshold.denominator >= (len(a) + len(b) - both) * threshold.numerator
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = X.SHINGLE,
                       threshold: Fraction = Fraction(4, 5), heavy_share: float = 0.002) -> DataFrame:
    """Link texts whose sets of distinct k-word shingles (words ``[^\\x20\\x09-\\x0D]+``,
    A-Z lower-cased) have a Jaccard similarity of ``threshold`` or more.

    Returns one row per input row: ``id_col, n_shingles, component_id`` (smallest id
    reachable over links, its own included). A text of fewer than k words has its whole
    sequence as one shingle. Null, empty or blank texts have an empty set and link with
    nothing, not even with each other. A row whose id is null keeps its size and has a
    null component. Repeated rows are equal sets and so share a component. Other
    columns are not read."""
    slack = (1 - threshold) / (1 + threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _survey(k, heavy_share)
    survey = stage(rows.mapInArrow(run, schema), "survey")
    texts = survey.where("sid is not null")
    sets = texts.where("n > 0 and id is not null").groupBy("sid").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    total = texts.where("n > 0").count()
    heavy = [r[0] for r in survey.where("shingle is not null").groupBy("shingle").agg(F.sum("texts").alias("c"))
             .where(F.col("c") >= max(4, heavy_share * total)).select("shingle").collect()]

    run, schema = _postings(k, threshold, np.array(heavy, np.int64).view(np.uint64))
    # one shuffle of the postings: keep those whose key another set has too. A window holds
    # an ordinary bucket, or one salt of a large one
    bucket = Window.partitionBy("key", "salt")
    posted = rows.mapInArrow(run, schema).select(
        "*", F.min("sid").over(bucket).alias("lo"), F.max("sid").over(bucket).alias("hi"))
    shared = stage(posted.where("salt > 0 or lo <> hi").select("key", "sid").distinct(), "postings")
    live = shared.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    members = stage(shared.join(live.select("key", "m"), "key"), "members")
    delete_stage(shared)

    # the best-connected member of each bucket is its centre
    weight = members.groupBy("sid").agg(F.sum("m").alias("w"))
    weighed = members.join(weight, "sid")
    centre = weighed.groupBy("key").agg(F.max(F.struct("w", "sid")).alias("c")).select("key", F.col("c.sid").alias("c"))
    star = (members.join(centre, "key").where("sid <> c")
            .select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct())
    light = sets.select("sid", "n", "sketch")

    def side(x: str, value: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
        return value.select(F.col("sid").alias(x), *[F.col(c).alias(n) for c, n in names])

    paired = star.join(side("a", light, [("n", "na"), ("sketch", "sa")]), "a").join(
        side("b", light, [("n", "nb"), ("sketch", "sb")]), "b")
    first = stage(paired.mapInArrow(_near(slack, threshold), "a long, b long"), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct().join(
            sets.select("sid", F.col("rep").alias("id")), "sid")
        fetch, kind = _shingle_rows(k)
        found = (rows.join(need.select("id").distinct(), "id").mapInArrow(fetch, kind)
                 .join(need, ["id", "sid"]).dropDuplicates(["sid"]).select("sid", "shingles"))
        found = stage(found, "sets")
        both = pairs.join(side("a", found, [("shingles", "xa")]), "a").join(side("b", found, [("shingles", "xb")]), "b")
        linked = stage(both.select("a", "b", "xa", "xb").mapInArrow(_linked(threshold), "a long, b long"), "links")
        delete_stage(found)
        return linked

    links = verified(first)
    roots = components(links)
    delete_stage(links)

    # buckets that still hold several components
    rest = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "key", "sid", F.coalesce("root", "sid").alias("root"))
    open_ = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    rest = rest.join(open_.select("key", "m"), "key").join(light, "sid")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), parts).cast("int")
    spread = rest.withColumn("p", mine).select(
        "key", "sid", "root", "n", "sketch",
        F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(
            F.least(q, F.col("p")).alias("i"), F.greatest(q, F.col("p")).alias("j"),
            F.when(q == F.col("p"), 2).when(F.col("p") < q, 0).otherwise(1).alias("side")))).alias("x")
    ).select("key", "x.i", "x.j", "x.side", "sid", "root", "n", "sketch")
    second = (spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
              .mapInArrow(_blocks(slack, threshold), "a long, b long")
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    second = stage(second.join(first, ["a", "b"], "left_anti"), "candidates")
    delete_stage(members)
    delete_stage(first)
    if not second.isEmpty():                 # join the components that the remaining links connect
        of = roots.select(F.col("node"), F.col("root"))
        more = verified(second)
        for end in ("a", "b"):
            more = more.join(of.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        upper = components(more)
        alone = upper.join(roots, "node", "left_anti")
        roots = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")).unionAll(alone.select("node", "root"))

    named = roots.join(sets.select(F.col("sid").alias("node"), "rep"), "node")
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").select(
        F.col("node").alias("sid"), "component")
    own = sets.select("sid", "rep").join(named, "sid", "left").select(
        "sid", F.coalesce("component", "rep").alias("component"))
    joined = texts.select("id", "n", "sid").join(own, "sid", "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None).cast("long"))
         .when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))
