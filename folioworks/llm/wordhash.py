"""Words and shingles of whole texts as 64-bit hashes, for a batch of texts at once.

A text is seen as UTF-8 bytes. Words are runs of bytes other than ASCII white space; A-Z count as a-z. A word's
hash depends on its bytes alone, so the same word has the same hash in each task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space: space and 0x09 to 0x0D.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BYTE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_BYTE = _BYTE[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_K = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bytes of text handled at once; a longer single text is handled alone.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts of about SLICE bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    texts = texts.cast(pa.large_string()).fill_null("") if n else pa.array([], pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of each word of the texts that `offsets` cut `data` into."""
    inside = ~IS_SPACE[data]
    if not inside.any():
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    gap = np.empty(len(data), bool)
    gap[0] = True
    np.logical_not(inside[:-1], out=gap[1:])
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    gap[edges] = True
    starts = np.flatnonzero(inside & gap)
    gap[:-1] = ~inside[1:]
    gap[-1] = True
    gap[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(inside & gap) + 1
    lengths = ends - starts
    at = np.arange(len(data), dtype=np.int64)[inside] - np.repeat(starts, lengths)
    value = (_LOWER_BYTE if lower else _BYTE)[data[inside]] * _powers(int(lengths.max()))[at]
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    h = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _K[0])
    doc = np.searchsorted(offsets, starts, "right") - 1
    return h, doc, starts, ends


def by_document(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The order by document and value."""
    order = np.argsort(values)
    small = doc.astype(np.uint16) if len(doc) and doc.max() < 1 << 16 else doc
    return order[np.argsort(small[order], kind="stable")]


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words per document, sorted by document and hash; a document with fewer words has its whole sequence as its only shingle, one without words has none."""
    count = np.bincount(doc, minlength=n_docs)
    if len(h) >= size:
        whole = doc[: len(h) - size + 1] == doc[size - 1 :]
        s = np.zeros(len(whole), np.uint64)
        for i in range(size):
            s = mix(s * _K[1] + h[i : i + len(whole)] + np.uint64(i))
        s, d = s[whole], doc[: len(whole)][whole]
    else:
        s, d = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.cumsum(count) - count
        extra = []
        for x in short:
            v = np.zeros(1, np.uint64)
            for i in range(count[x]):
                v = mix(v * _K[2] + h[first[x] + i : first[x] + i + 1] + np.uint64(count[x] * 64 + i))
            extra.append(v[0])
        s, d = np.concatenate([s, np.array(extra, np.uint64)]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    if not len(s):
        return s, d
    order = by_document(s, d)
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]
