"""Byte-level BPE: encode texts by a rank file, decode ids by joining binary pieces.

``fold_words`` is the named form: Spark higher-order functions fold the ranked merges
over the byte array of each distinct word, against a rank map held as a literal (hash
buckets of small maps, because a Spark map is searched linearly). ``encode`` applies the
same fold inside Arrow batches to the distinct words a task meets, all new words of a slice
of texts side by side; it is the form that meets the resource limits on whole corpora, where
mapping each of the words back to its place in the texts would need a shuffle of every word
(see README). ``decode`` is the higher-order form: the ids pick pieces from a literal table
and are concatenated.

A text is cut into pieces by the given pattern, each piece is merged by itself, without
special tokens. Pieces that are a token themselves are that token. Null and empty texts
have no tokens. A piece without any merge falls back to its single bytes, which every
byte-level rank file holds."""
from __future__ import annotations

import base64
import heapq
import json
import sys
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

CACHE_WORDS = 200_000       # distinct words a worker remembers; forgotten ones are folded again
CACHE_PIECE = 256           # longer pieces are never remembered
GROUP = 150_000             # pieces handled at once, and those of the text that fills the group
LONG_TEXT = 1 << 20         # longer texts are cut into several groups
SHORT = 48                  # bytes of a piece that is folded beside others, or with a plain list
SIDE = 4096                 # pieces folded side by side
NONE = np.int32(2**31 - 1)  # no merge


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file (base64 token, space, rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbours (leftmost on a tie) until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    scores = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while scores:
        best = min(scores)
        if best == 1 << 60:
            break
        i = scores.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a queue of pairs: n log n for very long pieces."""
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))     # part i is word[i:end[i]]
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = end[i]
        if not j or j >= n or not end[j] or end[j] != stop:       # a part of this pair has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            left[stop] = i
        for a in (left[i], i):
            if a >= 0 and end[a] < n and (r := ranks.get(word[a:end[end[a]]])) is not None:
                heapq.heappush(queue, (r, a, end[end[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class _Pairs:
    """All pairs of tokens that merge, in a hash table with linear probing. Tokens are
    numbered by rank, so of two merges the one with the smaller number goes first."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        number = {t: i for i, t in enumerate(tokens)}
        found = np.fromiter(((a, b, i) for i, t in enumerate(tokens) for j in range(1, len(t))
                             if (a := number.get(t[:j])) is not None and (b := number.get(t[j:])) is not None),
                            np.dtype((np.int64, 3)))
        left, right, merged = found.T
        self.single = np.array([number[bytes([i])] for i in range(256)], np.int32)
        self.rank = np.array([ranks[t] for t in tokens], np.int32)
        self.bits = (2 * len(found) + 256).bit_length()
        self.key, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key = left << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] < 0]
            self.key[slot[free]] = key[free]
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) % len(self.key)
        self.merged[slot] = merged

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair's merged token, or ``NONE``."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        held = self.key[slot]
        out = np.where(held == key, self.merged[slot], NONE)
        other = np.flatnonzero((held != key) & (held >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.key)
            held = self.key[slot[other]]
            out[other[held == key[other]]] = self.merged[slot[other]][held == key[other]]
            other = other[(held != key[other]) & (held >= 0)]
        return out


def _fold_side_by_side(words: list[bytes], pairs: _Pairs) -> list[bytes]:
    """``fold`` of many pieces of 2 to ``SHORT`` bytes that are no token themselves, as
    packed ids. Column w of the arrays is word w, row i its part that begins at byte i; a
    round does the next merge of every word that has one."""
    n, sizes = len(words), np.array(list(map(len, words)))
    width = int(sizes.max())
    row = np.arange(width + 1)[:, None]
    letters = np.zeros((n, width), np.uint8)
    letters[row[:-1].T < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    letters = letters.T
    part = pairs.single[letters]
    after, before = np.repeat(row + 1, n, 1).astype(np.int8), np.repeat(row - 1, n, 1).astype(np.int8)

    def order(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        merged = pairs.get(left, right)             # the lowest rank first, then the leftmost
        return np.where(merged == NONE, NONE, merged << 6 | at)

    first = order(part[:-1].ravel(), part[1:].ravel(), np.repeat(np.arange(width - 1, dtype=np.int32), n)).reshape(width - 1, n)
    first[row[1:-1] >= sizes] = NONE
    while len(w := np.flatnonzero((best := first.min(axis=0)) != NONE)):
        best = best[w]
        i, new = best & 63, best >> 6
        j = after[i, w]
        k = after[j, w]
        part[i, w], part[j, w] = new, -1
        after[i, w], before[k, w] = k, i
        at = np.minimum(j, width - 2)                # the last part begins no pair
        first[at, w] = np.where(j == at, NONE, first[at, w])
        first[i, w] = NONE
        x = np.flatnonzero(k < sizes[w])
        first[i[x], w[x]] = order(new[x], part[k[x], w[x]], i[x])
        x = np.flatnonzero(i > 0)
        h = before[i[x], w[x]]
        first[h, w[x]] = order(part[h, w[x]], new[x], h.astype(np.int32))
    left = (part >= 0) & (row[:-1] < sizes)
    packed = pairs.rank[part.T[left.T]].tobytes()
    ends = (4 * np.cumsum(left.sum(axis=0))).tolist()
    return [packed[a:b] for a, b in pairwise([0, *ends])]


class _Cache(dict):
    """piece -> its ids as packed 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        plain = all(bytes([i]) in ranks for i in range(256)) and len(set(ranks.values())) == len(ranks) < 1 << 25
        self.pairs = _Pairs(ranks) if plain else None

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(fold(piece.encode("utf-8"), self.ranks), np.int32).tobytes()
        if len(piece) <= CACHE_PIECE and len(self) < CACHE_WORDS:
            self[piece] = packed
        return packed

    def learn(self, pieces: set[str]) -> None:
        """Take up the new ones among the pieces, folded side by side. Long ones, and all of a
        rank file without some single byte or with a rank given twice, wait for their turn."""
        new = pieces.difference(self)
        if len(self) + len(new) > CACHE_WORDS:       # the others are forgotten
            kept = {p: self[p] for p in pieces if p in self}
            self.clear()
            self.update(kept)
        if self.pairs is None:
            return
        words = dict(zip(map(str.encode, new), new))
        for word in words.keys() & self.ranks.keys():
            self[words.pop(word)] = self.ranks[word].to_bytes(4, sys.byteorder, signed=True)
        short = sorted((w for w in words if 1 < len(w) <= SHORT), key=len)
        for a in range(0, len(short), SIDE):         # words of about one length share an array
            some = short[a:a + SIDE]
            self.update(zip([words[w] for w in some], _fold_side_by_side(some, self.pairs)))


_WORKER: dict[int, _Cache] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Callable:
    lines = b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in ranks.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(lines)
        if key not in _WORKER:
            _WORKER[key] = _Cache({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())})
        cache, cut = _WORKER[key], regex.compile(pattern)

        def known(texts: list[str | None]) -> Iterator[list[str] | None]:
            """The pieces of the texts, which the cache has taken up; None where a text ends."""
            held, n = [], 0
            for text in texts:
                if text and len(text) > LONG_TEXT:
                    found = cut.finditer(text)
                    cuts = iter(lambda: [m[0] for m in islice(found, GROUP)], [])
                else:
                    cuts = [cut.findall(text or "")]
                for pieces in cuts:
                    held.append(pieces)
                    n += len(pieces)
                    if n >= GROUP:
                        cache.learn(set(chain.from_iterable(p for p in held if p)))
                        yield from held
                        held, n = [], 0
                held.append(None)
            cache.learn(set(chain.from_iterable(p for p in held if p)))
            yield from held

        for batch in batches:
            for part in X.slices(batch, "text"):
                ids, offsets, total = [], [0], 0
                for pieces in known(part.column("text").to_pylist()):
                    if pieces is None:
                        offsets.append(total)
                        continue
                    ids.append(b"".join(map(cache.__getitem__, pieces)))
                    total += len(ids[-1]) // 4
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                columns = [c for i, c in enumerate(part.columns) if part.schema.names[i] != "text"]
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "ids"])
    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
           keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """``keep`` columns and ``out`` (array<int>): the ids of every whole text."""
    d = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"k{i} {d.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "ids array<int>"])
    done = d.mapInArrow(_encoder(ranks, pattern), schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(out))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The ids' pieces, concatenated, as binary (null for null; ids outside the file give
    nothing). The literal table holds the pieces in hexadecimal, by id."""
    table = [""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece.hex()
    pieces = F.split(F.lit(",".join(table)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def rank_map(ranks: dict[bytes, int], buckets: int = 65_536) -> Column:
    """The ranks as one literal: array of hash buckets, each a small map."""
    held: list[dict[str, int]] = [{} for _ in range(buckets)]
    for piece, r in ranks.items():
        h = piece.hex().upper()
        held[zlib.crc32(h.encode()) % buckets][h] = r
    return F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word", out: str = "ids",
               buckets: int = 65_536) -> DataFrame:
    """Add the ids of each word by higher-order functions only. One step of the fold
    ranks all neighbouring pairs and merges the leftmost of the lowest rank; a word of n
    bytes needs n - 1 steps at most."""
    table = rank_map(ranks, buckets)

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.get(table, F.pmod(F.crc32(piece), F.lit(buckets)).cast("int")), piece)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.concat(p, F.get(parts, i + 1)))
        scored = F.transform(pairs, lambda p, i: F.struct(F.coalesce(rank(p), F.lit(1 << 30)).alias("r"), i.alias("i")))
        merge = F.transform(F.array(F.array_min(scored)), lambda b: F.when(
            (b["r"] < (1 << 30)), F.concat(
                F.slice(parts, 1, b["i"]), F.array(F.concat(F.get(parts, b["i"]), F.get(parts, b["i"] + 1))),
                F.slice(parts, b["i"] + 3, F.size(parts)))).otherwise(parts))
        return F.when(F.size(parts) < 2, parts).otherwise(F.get(merge, 0))

    start = F.regexp_extract_all(F.hex(F.encode(F.col(word_col), "UTF-8")), F.lit("(..)"))
    parts = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(start) - 2, F.lit(0))), start, step)
    whole = F.hex(F.encode(F.col(word_col), "UTF-8"))
    return words.withColumn(out, F.when(F.col(word_col) == "", F.array().cast("array<int>"))
                            .when(rank(whole).isNotNull(), F.array(rank(whole)))
                            .otherwise(F.transform(parts, rank)))


def round_trip_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids joined by commas), decoded_sha256."""
    coded = encode(docs, ranks, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
