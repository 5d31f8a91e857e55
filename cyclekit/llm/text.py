"""Words, word hashes and 5-word shingles of Arrow text columns, as numpy arrays.

A word is a maximal run of bytes other than the six ASCII white-space bytes
(``[^\\x20\\x09-\\x0D]+``). Those bytes never occur inside a multi-byte UTF-8
sequence, so working on bytes gives the same words as working on characters. Whole texts
are processed; a batch is cut into slices of half a MB, hashed in chunks of 128 KB, so that memory
stays bounded by the slice (or by one text, when a single text is larger): a slice needs
arrays of many times its bytes, and a reused worker keeps much of what it once took."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
HASH_CHUNK = 1 << 17
SHINGLE = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (array arithmetic wraps modulo 2**64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
_POW: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(HASH_CHUNK + 1, base, np.uint64)
            p[0] = 1
            _POW.append(np.multiply.accumulate(p))
    return _POW[0], _POW[1]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of length n + 1) of a string or binary array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset:]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[n]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose texts hold about ``limit`` bytes each (one text at least)."""
    size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
    off = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)])
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(off, off[start] + limit, side="left"))
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of a run of texts. ``first[i]:first[i+1]`` are the words of text i."""
    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    space: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False) -> Words:
    buf, off = text_buffer(texts)
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    space = _SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= space[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(buf, off, start, end, np.searchsorted(start, off), space)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (ascending, not overlapping): a polynomial hash
    modulo 2**64 over random byte values, from one running sum per chunk."""
    out = np.empty(len(start), np.uint64)
    up, down = _powers()
    i, n = 0, len(start)
    while i < n:
        j = max(int(np.searchsorted(end, start[i] + HASH_CHUNK, side="right")), i + 1)
        a, b = int(start[i]), int(end[j - 1])
        if b - a > HASH_CHUNK:                       # one span longer than a chunk
            h = np.zeros(1, np.uint64)
            for k in range(a, b, HASH_CHUNK):
                part = _BYTE[buf[k:min(k + HASH_CHUNK, b)]]
                h = mix(h + (part * up[:len(part)]).sum(dtype=np.uint64, keepdims=True))
            out[i] = h[0]
        else:
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[buf[a:b]] * up[:b - a], out=run[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out + (end - start).astype(np.uint64) * _U(0xE7037ED1A0B428DB))


def word_hashes(w: Words) -> np.ndarray:
    return span_hashes(w.buf, w.start, w.end)


def window_hashes(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k consecutive values (n - k + 1 of them)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _PLACE[0]
    for t in range(1, k):
        out += h[t:m + t] * _PLACE[t]
    return mix(out)


def text_shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per text, its k-word shingle hashes in order; a text of 1 to k - 1 words gives
    its whole word sequence as one shingle, a text without words gives none."""
    wide = window_hashes(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= k:
            yield wide[a:b - k + 1]
        elif n:
            yield mix((h[a:b] * _PLACE[8:8 + n]).sum(dtype=np.uint64, keepdims=True) + _U(n))
        else:
            yield h[:0]
