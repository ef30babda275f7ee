"""Vectorised words of whole texts, read from Arrow buffers.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, with A-Z lower-cased; texts are UTF-8, so other
letters stay as they are. A word stands for its 64-bit hash.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of terms: ASCII other than letters and digits.
ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: An odd base, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a word across that border is carried over whole.
CHUNK = 1 << 20
_powers, _inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK, x, np.uint64))]) for x in (_BASE, _INVERSE))


def trim() -> None:
    """Give memory that isn't in use back to the system; else a Python worker holds on to the most it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call everywhere
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """``run``, a function over batches, which gives memory back in the end."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashed(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a stretch of at most CHUNK bytes."""
    space = np.concatenate([[True], gap[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers[: len(data)])])
    return mix((sums[ends] - sums[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64)), starts, ends


def hash_bytes(data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of all words of ``data``, however long it is."""
    if len(data) <= CHUNK:
        return _hashed(data, gap)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            gaps = np.flatnonzero(gap[data[at:end]])
            if len(gaps) and gaps[-1] > 0:
                end = at + int(gaps[-1])
            else:  # one word longer than a chunk: its pieces' hashes are folded into one
                stop = end
                while stop < len(data) and not gap[data[stop]]:
                    stop += 1
                folded = np.uint64(0)
                for k in range(at, stop, CHUNK):
                    h, _, _ = _hashed(data[k : min(stop, k + CHUNK)], gap)
                    with np.errstate(over="ignore"):
                        folded = np.uint64(folded * np.uint64(_BASE)) + (h[0] if len(h) else np.uint64(0))
                lead = at + int(gap[data[at]])
                parts.append((mix(np.array([folded])), np.array([lead]), np.array([stop])))
                at = stop
                continue
        h, s, e = _hashed(data[at:end], gap)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))


def prefix_hashes(data: np.ndarray | None, lengths: tuple[int, ...], gap: np.ndarray = _SPACE) -> np.ndarray:
    """Hashes of the first bytes of each word that is longer than so many, for each of ``lengths``."""
    out = [np.zeros(0, np.uint64)]
    if data is not None and len(data):
        _, starts, ends = hash_bytes(data, gap)
        low = (_LOWER[data].astype(np.uint64) + np.uint64(1)) if len(data) else np.zeros(0, np.uint64)
        most = max(lengths)
        h = np.zeros(len(starts), np.uint64)
        for n in range(1, most + 1):
            long_enough = ends - starts >= n
            starts, ends, h = starts[long_enough], ends[long_enough], h[long_enough]
            h = h * np.uint64(_BASE) + low[starts + n - 1]
            if n in lengths:
                out.append(mix(h[ends - starts > n] + np.uint64(n << 32)))
    return np.concatenate(out)


def texts_of(column: pa.ChunkedArray | pa.Array):
    """The bytes of each text, as views of the Arrow buffer; None for nulls."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(chunk)):
            yield body[at[k] : at[k + 1]] if valid[k] else None


def words(data: np.ndarray | None, gap: np.ndarray = _SPACE) -> np.ndarray:
    return np.zeros(0, np.uint64) if data is None else hash_bytes(data, gap)[0]


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of runs of ``n`` words; with fewer words, the whole sequence as one."""
    if not len(w):
        return w
    n = min(n, len(w))
    out = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out) + w[k : len(w) - n + 1 + k]
    return np.unique(mix(out))
