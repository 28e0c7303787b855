"""Words of Arrow text batches as numpy arrays: whole batches at a time, without a Python object a word.

A word is a run of digits, ASCII letters (lower-cased) and all characters beyond ASCII, as in
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over lower-cased text. It is known by a 64-bit hash of its UTF-8 bytes
(a polynomial, then mixed); hashes are the same in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20  # bytes hashed at a time
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_classes() -> np.ndarray:
    """1 for bytes of words."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = 1
    return table


WORD_BYTES = byte_classes()
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += U(32)
LOWER += U(1)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2^64."""
    if not _POWERS:
        def powers(x: int) -> np.ndarray:
            out = np.full(PIECE + 1, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)
        _POWERS.extend((powers(_BASE), powers(pow(_BASE, -1, 1 << 64))))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the runs in ``mask``, broken where a text begins; then the first run of each text."""
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(mask)]
    first[cuts] = mask[cuts]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = cuts[cuts > 0]
    last[inner - 1] = mask[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """Hash of the bytes of each run, piece by piece so that memory stays bounded."""
    out = np.empty(len(begin), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(begin):
        at = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, at + PIECE, "right")))
        if end[j - 1] - at > PIECE:  # one run longer than a piece
            total = np.zeros(1, np.uint64)
            for low in range(at, int(end[i]), PIECE):
                part = values[data[low:min(low + PIECE, int(end[i]))]]
                total = mix(total + (part * up[:len(part)]).sum(dtype=np.uint64))
            out[i] = total[0]
        else:
            part = values[data[at:int(end[j - 1])]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[:len(part)], out=sums[1:])
            b, e = begin[i:j] - at, end[i:j] - at
            out[i:j] = (sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (bytes) of each word, and the first word of each text."""
    begin, end, first = runs(WORD_BYTES[data].astype(bool), offsets)
    return run_hashes(data, begin, end), begin, end, first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one text, in order, and the first shingle of each text.

    A text of fewer words, but not none, is one shingle.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(start[-1], np.uint64)
    factor = mix(np.arange(1, size + 1, dtype=np.uint64) * U(_BASE)) | U(1)
    if len(hashes) >= size:
        rolled = np.zeros(len(hashes) - size + 1, np.uint64)
        for k in range(size):
            rolled += hashes[k:len(rolled) + k] * factor[k]
        full = counts >= size
        # every position of a long text but its last size - 1
        place = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], n)
        own = np.repeat(full, n)
        out[own] = rolled[place[own]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        k = counts[d]
        out[start[d]] = (hashes[first[d]:first[d + 1]] * factor[:k]).sum(dtype=np.uint64) + U(k)
    return mix(out), start


def slices(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(text_buffers(batch.column(column))[1])
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    yield batch.slice(begin)
