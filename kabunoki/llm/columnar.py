"""Byte-level numpy kernels over Arrow string buffers.

Nothing here makes a Python string: words, their hashes and their n-grams are computed on the UTF-8 bytes of a
whole batch of texts at once. A word is a maximal run of ASCII letters and digits and of any non-ASCII characters,
after lower-casing; a null text has no words, as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[np.r_[48:58, 97:123, 128:256]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads its input over all bits (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        b = np.full(size, _BASE, dtype=U64)
        b[0] = 1
        i = np.full(size, pow(_BASE, -1, 1 << 64), dtype=U64)
        i[0] = 1
        _pow, _inv = np.multiply.accumulate(b), np.multiply.accumulate(i)
    return _pow[:n], _inv[:n]


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets (from 0) of a string array; nulls have length 0."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if strings.null_count:
        strings = pc.fill_null(strings, "")
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(strings) else np.zeros(0, np.uint8)
    return raw, (off - off[0]) if len(off) else np.zeros(1, np.int64)


def chunks(strings: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``most`` bytes (one longer text is a slice of its own) and where they start."""
    _, off = buffers(strings)
    at = 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, strings.slice(at, to - at)
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word, in order."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = _WORD[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    cuts = off[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    ends = off[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    p, inv = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * p[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * inv[start] + (end - start).astype(U64))


def ngrams(word: np.ndarray, text: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all word n-grams; a text of 1 to n-1 words has one gram, all of its words."""
    odd = [U64((0xD6E8FEB86659FD93 * (2 * k + 3)) & (2**64 - 1) | 1) for k in range(n)]
    m = len(word) - n + 1
    if m > 0:
        g = word[:m] * odd[0]
        for k in range(1, n):
            g += word[k : m + k] * odd[k]
        ok = text[:m] == text[n - 1 :]
        g, at = mix64(g[ok]), text[:m][ok]
    else:
        g, at = np.zeros(0, U64), np.zeros(0, np.int64)
    count = np.bincount(text, minlength=texts)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(text, few)
        h = np.zeros(len(few), U64)
        for k in range(n - 1):
            on = count[few] > k
            h[on] += word[first[on] + k] * odd[k]
        g = np.concatenate([g, mix64(h + count[few].astype(U64))])
        at = np.concatenate([at, few])
    return g, at


def lower(strings: pa.Array) -> pa.Array:
    return pc.utf8_lower(strings)


def word_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the lower-cased texts."""
    raw, off = buffers(lower(strings))
    s, e, t = words(raw, off)
    return span_hashes(raw, s, e), t


def pack(x: np.ndarray) -> bytes:
    """A sorted array of 64-bit integers as differences in byte planes, which the shuffle's codec shortens."""
    d = np.diff(x.astype(U64, copy=False), prepend=U64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8)
    d = np.ascontiguousarray(planes.reshape(8, -1).T).view(U64).ravel() if len(planes) else np.zeros(0, U64)
    return np.cumsum(d, dtype=U64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[i] .. start[i]+length[i]."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)
