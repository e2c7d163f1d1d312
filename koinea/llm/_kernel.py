"""Vectorised word kernels over Arrow text columns.

Whole batches are tokenised and hashed with numpy on the raw UTF-8 bytes; no Python loop runs per
word. Temporaries are bounded: text is walked in segments of about ``SEGMENT`` bytes, cut at word
ends, so one very long document needs no more scratch memory than many short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
LONG = 128  # spans of more bytes are hashed one by one
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mix = _splitmix


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, filled = np.uint64(base), 1
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * step
            step = np.uint64((int(step) * int(step)) & _MASK)
            filled += take
    return out


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]  # A-Z count as a-z
_BYTE_VALUES_CASED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_FORWARD: np.ndarray = _powers(_P, SEGMENT * 2)
_BACKWARD: np.ndarray = _powers(_P_INVERSE, SEGMENT * 2)

#: Bytes that belong to a word, by word rule.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = True
ALPHANUMERIC[0x41:0x5B] = True
ALPHANUMERIC[0x61:0x7B] = True
ALPHANUMERIC[0x80:] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def doc_ranges(offsets: np.ndarray, limit: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``limit`` bytes each, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; documents never share a word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = rule[data]
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | breaks[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of every span (sorted, not overlapping); equal bytes have equal hashes, A-Z as a-z if fold."""
    out = np.empty(len(starts), np.uint64)
    values = _BYTE_VALUES if fold else _BYTE_VALUES_CASED
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            base = int(starts[k])
            j = max(k + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
            size = int(ends[j - 1]) - base
            if size > len(_FORWARD):  # one span longer than the tables
                forward, backward = _powers(_P, size), None
            else:
                forward, backward = _FORWARD, _BACKWARD
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(values[data[base : base + size]] * forward[:size], out=sums[1:])
            s, e = starts[k:j] - base, ends[k:j] - base
            raw = sums[e] - sums[s]
            raw *= backward[s] if backward is not None else np.uint64(1)
            out[k:j] = mix(raw + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            k = j
    # sums modulo a power of two cannot tell some long regular spans apart
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        own = data[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(own.lower() if fold else own, digest_size=8).digest(), "little")
    return out


def cut_after(data: np.ndarray, start: int, cut: int, end: int, rule: np.ndarray) -> int:
    """The first place from cut on that is not within a word."""
    cut = min(cut, end)
    while start < cut < end and rule[data[cut]] and rule[data[cut - 1]]:
        gap = np.flatnonzero(~rule[data[cut : min(end, cut + SEGMENT)]])
        cut = cut + int(gap[0]) if len(gap) else min(end, cut + SEGMENT)
    return cut


def words(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each document the index of its first word (n+1 values)."""
    hashes, counts = [], []
    for i, j in doc_ranges(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        part, at = data[lo:hi], offsets[i : j + 1] - lo
        if len(part) <= 8 * SEGMENT:
            starts, ends = word_spans(part, at, rule)
            hashes.append(span_hashes(part, starts, ends))
            counts.append(np.diff(np.searchsorted(starts, at)))
            continue
        total, here = 0, 0  # one long document, in pieces that end between words
        while here < len(part):
            cut = cut_after(part, here, here + 4 * SEGMENT, len(part), rule)
            piece = part[here:cut]
            starts, ends = word_spans(piece, np.array([0, len(piece)]), rule)
            hashes.append(span_hashes(piece, starts, ends))
            total += len(starts)
            here = cut
        counts.append(np.array([total]))
    first = np.zeros(len(offsets), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=first[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first


_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one document; fewer than n words make one shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    size = min(n, len(hashes))
    with np.errstate(over="ignore"):
        acc = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            acc = (acc ^ hashes[k : len(hashes) - size + 1 + k]) * _A
            acc ^= acc >> np.uint64(29)
        return np.unique(mix(acc + _B))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array for each row."""
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
