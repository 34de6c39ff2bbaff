"""Vectorised word shingles of Arrow text batches.

Words are maximal runs of bytes other than space and 0x09-0x0D of the UTF-8
text, after A-Z became a-z.  A document's set holds the distinct hashes of its
n-word shingles; a document of fewer words has one shingle, all its words; a
document without words (or a null text) has the empty set.

Hashes have 64 bits: a polynomial over the bytes of each word with a fixed odd
multiplier, mixed, then combined over the n words in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: One mixed 64-bit value for each byte, A-Z as a-z.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k, top = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * top
        top = top * top
        k *= 2
    return out


#: Bytes that are hashed at once; a single longer word is one part.
PART = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word of texts data[offsets[i]:offsets[i+1]], in parts of bounded size."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data, offsets = data[lo:hi], offsets - lo
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + PART)
        while end < len(data) and not _SPACE[data[end]]:  # a part ends before white space, so within no word
            gap = np.flatnonzero(_SPACE[data[end : end + PART]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + PART)
        edges = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, end)] - at
        words, start = _part_hashes(data[at:end], edges)
        hashes.append(words)
        starts.append(start + at)
        at = end
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(offsets, start, side="right") - 1


def _part_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of data; edges: where new documents begin within."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]  # a word never crosses documents
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_P, len(data)), out=total[1:])
        words = (total[end] - total[start]) * _powers(_P_INV, len(data))[start]
        return _mix(words + (end - start).astype(np.uint64)), start


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): document i has the sorted distinct hashes[bounds[i]:bounds[i+1]]."""
    docs = len(offsets) - 1
    words, doc = word_hashes(data, np.asarray(offsets, np.int64))
    count = np.bincount(doc, minlength=docs)
    begin = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        acc = np.zeros(len(words), np.uint64)
        reach = np.minimum(n, count)[doc]  # words in this document's shingles
        for k in range(n):
            has = reach > k
            at = np.flatnonzero(has)
            at = at[at + k < len(words)]
            acc[at] = _mix(acc[at] * np.uint64(0xA0761D6478BD642F) + words[at + k] + np.uint64(k + 1))
    left = begin[doc + 1] - np.arange(len(words))
    keep = left >= reach
    hashes, doc = acc[keep], doc[keep]
    edge = np.searchsorted(doc, np.arange(docs + 1))
    for i in range(docs):
        hashes[edge[i] : edge[i + 1]].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    return hashes, np.searchsorted(doc, np.arange(docs + 1))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    return (np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)), offsets
