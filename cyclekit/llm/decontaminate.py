"""Benchmark decontamination by SimHash over item-sized windows.

1. Every word position of every text gets the 64-bit SimHash of the windows that start
   there, one per window size. Sizes form a grid; an item of n words uses the largest
   grid size that is at most 0.8 n (so that every stretch of text that can reach the
   similarity holds such a window), fingerprinted at its first, middle and last words.
   Bit counts are kept as running sums, eight counters of 8 bits in a 64-bit integer,
   so a window costs one subtraction per eight bits.
2. A multi-index finds all fingerprints within the radius: the 64 bits are cut in four
   blocks; of two fingerprints that differ in at most ``radius`` bits, one block differs in
   at most ``radius // 4``. Each block index holds every item block and its neighbours
   within that distance, so no pair within the radius is missed.
3. A candidate fixes where the item would start. Neighbouring candidates of a text and item
   are verified together: the item-sized stretch slides over all starts from a quarter item
   before the first to a quarter item behind the last, and is compared at each by weighted
   Jaccard similarity of 5-word shingles, kept up to date word by word; a shingle weighs
   1 / (number of items that hold it), so phrases shared by many items count less. At the
   ends of a text a stretch may be cut, down to three quarters of the item.

Benchmark items are a query set of checked size: they are taken in blocks of at most
``block_items`` items, one pass over the documents each."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

_U = np.uint64
BLOCKS = 4
GRID = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 19, 24, 30, 37, 46, 58, 72, 90, 112, 140, 175, 220)
NARROW, WIDE = 255, 1 << 16     # greatest windows of counters of 8 and of 16 bits
CHUNK = 1 << 21                 # candidates that are tested at once
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_SPREAD16 = np.array([sum(((b >> i) & 1) << (16 * i) for i in range(4)) for b in range(16)], np.uint64)


class Counters:
    """Running bit counts of the word hashes: lane j holds bits 8j to 8j + 7, or, for windows above
    NARROW words (built when first asked for), bits 4j to 4j + 3."""

    def __init__(self, h: np.ndarray):
        self.h, self.lanes, self.wide = h, [], []
        for j in range(8):
            run = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(_SPREAD[((h >> _U(8 * j)) & _U(255)).astype(np.intp)], out=run[1:])
            self.lanes.append(run)

    def _wide(self) -> list[np.ndarray]:
        if not self.wide:
            for j in range(16):
                run = np.zeros(len(self.h) + 1, np.uint64)
                np.cumsum(_SPREAD16[((self.h >> _U(4 * j)) & _U(15)).astype(np.intp)], out=run[1:])
                self.wide.append(run)
        return self.wide

    def fingerprints(self, size: int) -> np.ndarray:
        """SimHash of each window of ``size`` words: a bit is set where more than half of the words set it."""
        out = np.zeros(max(0, len(self.h) + 1 - size), np.uint64)
        if size > NARROW:
            bias = _U((32767 - size // 2) * 0x0001000100010001)
            for j, run in enumerate(self._wide()):
                high = ((run[size:] - run[:-size] + bias) & _U(0x8000800080008000)) >> _U(15)
                out |= ((high | (high >> _U(15)) | (high >> _U(30)) | (high >> _U(45))) & _U(15)) << _U(4 * j)
            return out
        bias = _U((127 - size // 2) * 0x0101010101010101)
        for j, run in enumerate(self.lanes):
            high = ((run[size:] - run[:-size] + bias) & _U(0x8080808080808080)) >> _U(7)
            out |= ((high * _U(0x0102040810204080)) >> _U(56)) << _U(8 * j)
        return out


def window_size(n: int) -> int:
    """The largest grid size of at most 0.8 n words; beyond the listed sizes the grid goes on in
    steps of a quarter, up to WIDE words."""
    most = min(max(1, int(0.8 * n)), WIDE)
    size = max(g for g in GRID if g <= most)
    while (wider := size * 5 // 4) <= most and size >= GRID[-1]:
        size = wider
    return size


class Index:
    """Items, their anchors' fingerprints by window size, and the block tables."""

    def __init__(self, ids: list, texts: list, radius: int = 7, k: int = X.SHINGLE):
        w = X.words(pa.array(texts, pa.string()), lower=True)
        h = X.word_hashes(w)
        self.ids, self.radius, self.k = ids, radius, k
        self.words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.bags = [np.unique(s, return_counts=True) for s in X.text_shingles(h, w.first, k)]
        every, held = np.unique(np.concatenate([b[0] for b in self.bags] or [h[:0]]), return_counts=True)
        self.known, self.weight = every, 1.0 / held
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            n = len(words)
            if n:
                size = window_size(n)
                prints = Counters(words).fingerprints(size)
                for o in sorted({0, (n - size) // 2, n - size}):
                    anchors.setdefault(size, []).append((int(prints[o]), i, o))
        self.sizes = {}
        for size, rows in anchors.items():
            prints = np.array([r[0] for r in rows], np.uint64)
            tables = []
            for b in range(BLOCKS):
                value = ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
                near = [(v ^ m, r) for r, v in enumerate(value.tolist()) for m in _masks(radius // BLOCKS)]
                near = np.array(sorted(near), np.int64).reshape(-1, 2)
                first = np.searchsorted(near[:, 0], np.arange(65537))
                tables.append((np.diff(first) > 0, first, near[:, 1]))
            self.sizes[size] = (prints, np.array([r[1:] for r in rows], np.int64), tables)

    def candidates(self, c: Counters, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position where the item would start, item) of all fingerprints within the
        radius. Windows do not cross texts: ``doc`` is the text of each word."""
        starts, items = [], []
        for size, (prints, anchors, tables) in self.sizes.items():
            f = c.fingerprints(size)
            if not len(f):
                continue
            inside = doc[:len(f)] == doc[size - 1:]
            for b, (has, first, rows) in enumerate(tables):
                v = ((f >> _U(16 * b)) & _U(0xFFFF)).astype(np.int32)
                every = np.flatnonzero(has[v] & inside)
                many = np.cumsum(first[v[every] + 1] - first[v[every]])
                cuts = np.searchsorted(many, np.arange(CHUNK, int(many[-1]) if len(many) else 0, CHUNK))
                for p in np.split(every, np.unique(cuts)):
                    lo = first[v[p]]
                    n = first[v[p] + 1] - lo
                    p2 = np.repeat(p, n)
                    r = rows[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                    ok = np.bitwise_count(f[p2] ^ prints[r]) <= self.radius
                    starts.append(p2[ok] - anchors[r[ok], 1])
                    items.append(anchors[r[ok], 0])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.column_stack([np.concatenate(starts), np.concatenate(items)]), axis=0)
        return both[:, 0], both[:, 1]

    def _weights(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, self.weight[at], 1.0)

    def best_place(self, h: np.ndarray, lo: int, hi: int, item: int, least: float) -> tuple[float, int, int] | None:
        """(similarity, first word, words) of the most similar stretch of the text's word hashes ``h``
        among those that start at ``lo`` to ``hi`` (the first on a tie), or None if none reaches
        ``least``. Starts may lie outside of the text, stretches are cut to it."""
        n = len(self.words[item])
        bag, many = self.bags[item]
        k = self.k if n >= self.k else n
        total = float((self._weights(bag) * many).sum())
        a, b = max(lo, 0), min(hi + n, len(h))
        if b - a < k or not total:
            return None
        if n >= self.k:
            grams = X.window_hashes(h[a:b], k)
        else:
            grams = np.array([next(X.text_shingles(h[i:i + n], np.array([0, n]), self.k))[0] for i in range(a, b - n + 1)], np.uint64)
        weight = self._weights(grams)
        at = np.minimum(np.searchsorted(bag, grams), len(bag) - 1)
        mine = bag[at] == grams
        if float(weight[mine].sum()) < least * total:            # not even all of them together
            return None
        run = np.concatenate([[0.0], np.cumsum(weight)]).tolist()
        slot, heavy = np.where(mine, at, -1).tolist(), weight.tolist()
        room, held, both = many.tolist(), [0] * len(bag), 0.0
        best, first, last = None, 0, 0                           # grams [first, last) are counted
        for p in range(lo, hi + 1):
            s, e = max(p, 0), min(p + n, len(h))
            if e - s < max(0.75 * n, k):
                continue
            until = e - a - k + 1
            while last < until:
                x = slot[last]
                if x >= 0:
                    if held[x] < room[x]:
                        both += heavy[last]
                    held[x] += 1
                last += 1
            while first < s - a:
                x = slot[first]
                if x >= 0:
                    held[x] -= 1
                    if held[x] < room[x]:
                        both -= heavy[first]
                first += 1
            score = both / (run[last] - run[first] + total - both)
            if score >= least and (best is None or score > best[0] + 1e-12):
                best = (score, s, e - s)
        return best


def _masks(distance: int) -> list[int]:
    out = {0}
    for _ in range(distance):
        out |= {m ^ (1 << b) for m in out for b in range(16)}
    return sorted(out)


def _search(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc": [], "item": [], "start": [], "words": [], "similarity": []}
            for part in X.slices(batch, "text"):
                w = X.words(part.column("text"), lower=True)
                h = X.word_hashes(w)
                ids = part.column("doc").to_pylist()
                for lo, hi in _groups(w.first):
                    own = h[w.first[lo]:w.first[hi]]
                    doc = np.repeat(np.arange(lo, hi), np.diff(w.first[lo:hi + 1]))
                    starts, items = index.candidates(Counters(own), doc)
                    size = np.array([len(x) for x in index.words] or [0])[items]
                    # the candidate may start before the text: look at its owner through its middle word
                    of = doc[np.clip(np.maximum(starts, 0) + size // 2, 0, max(len(doc) - 1, 0))] if len(doc) else starts
                    order = np.lexsort((starts, items, of))
                    starts, items, of, size = starts[order], items[order], of[order], size[order]
                    apart = (np.diff(of) != 0) | (np.diff(items) != 0) | (np.diff(starts) > size[1:])
                    runs = np.concatenate([[0], np.flatnonzero(apart) + 1, [len(starts)]]) if len(starts) else [0]
                    best: dict[tuple[int, int], tuple] = {}
                    for x, y in zip(runs[:-1], runs[1:]):
                        d, i, n = int(of[x]), int(items[x]), int(size[x])
                        a, b = int(w.first[d] - w.first[lo]), int(w.first[d + 1] - w.first[lo])
                        found = index.best_place(own[a:b], int(starts[x]) - a - n // 4, int(starts[y - 1]) - a + n // 4, i, threshold - 1e-9)
                        if found and ((d, i) not in best or found[0] > best[d, i][0] + 1e-12):
                            best[d, i] = found
                    for (d, i), (score, s, n) in sorted(best.items()):
                        for name, v in zip(out, (ids[d], index.ids[i], s, n, score)):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc"], pa.int64()), pa.array(out["item"], pa.int64()), pa.array(out["start"], pa.int64()),
                 pa.array(out["words"], pa.int64()), pa.array(out["similarity"], pa.float64())], names=list(out))
    return run


def _groups(first: np.ndarray, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` words (one text at least)."""
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(first, first[lo] + limit, side="right")) - 1))
        yield lo, hi
        lo = hi


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", threshold: float = 0.8, radius: int = 7,
                 block_items: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """``id_col, item_col, start_word, n_words, similarity``: one row per text and item
    found in it, with its most similar place (first on a tie). Texts and items that are
    null or without words match nothing; items of fewer than 5 words are one shingle
    and match only as the whole stretch. Items that repeat are reported under each id;
    texts and items with a null id are searched too and reported with a null id (equal
    items with a null id once). Extra columns are not read."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")
                             ).where("text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // block_items), -(-size // block_bytes))
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        index = Index([r[0] for r in rows], [r[1] for r in rows], radius)
        part = d.mapInArrow(_search(index, threshold), "doc long, item long, start long, words long, similarity double")
        found = part if found is None else found.unionAll(part)
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("start").alias("start_word"),
                        F.col("words").alias("n_words"), "similarity")
