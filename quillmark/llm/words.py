"""Words as 64-bit hashes: the numpy kernels of the word and shingle operators.

A word is a run of bytes other than space and U+0009..U+000D, as in
``[^\\x20\\x09-\\x0D]+``. Texts are read as UTF-8 straight from Arrow buffers.
Hashes are polynomials over bytes (and over word hashes for windows) modulo
2**64 with an odd base, each finished with a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW, _INV = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (UTF-8), offsets and validity of an Arrow string or binary column, without copies."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off, np.asarray(column.is_valid())


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~SPACE[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each word of the bytes, and the words' bounds. lower: A-Z count as a-z."""
    if lower:
        buf = _LOWER[buf]
    starts, ends = bounds(buf)
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        s0 = starts[i]
        j = int(np.searchsorted(ends, s0 + _CHUNK, "right"))
        if j <= i:  # one word longer than a chunk
            out[i] = U64(xxhash.xxh64_intdigest(buf[s0 : ends[i]].tobytes()))
            i += 1
            continue
        seg = buf[s0 : ends[j - 1]]
        total = np.zeros(len(seg) + 1, U64)
        np.cumsum(_BYTE[seg] * _POW[: len(seg)], out=total[1:])
        a, b = starts[i:j] - s0, ends[i:j] - s0
        out[i:j] = mix((total[b] - total[a]) * _INV[a] + (b - a).astype(U64))
        i = j
    return out, starts, ends


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k items of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    step = _CHUNK - k
    for i in range(0, n, step):
        seg = h[i : i + step + k - 1]
        total = np.zeros(len(seg) + 1, U64)
        np.cumsum(seg * _POW[: len(seg)], out=total[1:])
        m = len(seg) - k + 1
        out[i : i + m] = mix((total[k:] - total[:-k]) * _INV[:m] + U64(k))
    return out


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct k-word shingles; the whole sequence if it is shorter; none without words."""
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))))


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w items, the position of its first smallest one."""
    n = len(x) - w + 1
    out = np.empty(max(0, n), np.int64)
    for i in range(0, n, 1 << 16):
        m = min(1 << 16, n - i)
        out[i : i + m] = np.lib.stride_tricks.sliding_window_view(x[i : i + m + w - 1], w).argmin(1) + np.arange(i, i + m)
    return out


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:-1]) > 0
