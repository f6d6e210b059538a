"""Whole Arrow batches of texts as numpy arrays: words, word hashes, shingles.

Words are hashed to 64 bits eight bytes at a time, each step mixing the bytes into all that
came before, so that no family of words shares a hash by its form; two of n different words
that were not made for it do with a chance of n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.ones(256, bool)  # separators of words of letters, digits and all beyond ASCII
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Longer words, which are rare, are hashed one by one.
LONG = 1024
#: The low 0 to 8 bytes of a number.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value for each (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(keys: np.ndarray) -> np.ndarray:
    """The different keys in order, by a sort: np.unique() hashes numbers one by one, which takes 75 times as long for 8 million."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes each, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; rows are those that off bounds."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[buf]
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(inside & last) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as a number, with zeros beyond its end."""
    return np.ndarray(len(buf), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each buf[s:e], by default with A-Z lower-cased."""
    if not len(s):
        return np.zeros(0, np.uint64)
    if lower:
        buf = LOWER[buf]
    from_here, n = eights(buf), e - s
    with np.errstate(over="ignore"):
        out = mix((from_here[s] & KEEP[np.minimum(n, 8)]) + mix(n.astype(np.uint64)))
        a, k = np.flatnonzero((n > 8) & (n <= LONG)), 8
        while len(a):
            out[a] = mix(out[a] * np.uint64(0xD6E8FEB86659FD93) + (from_here[s[a] + k] & KEEP[np.minimum(n[a] - k, 8)]))
            k += 8
            a = a[n[a] > k]
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of k words of a row; a shorter row is one run."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(len(h), np.uint64)
    seed = np.uint64(k)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(np.arange(len(h)) + k <= first[row + 1]) if len(h) else np.zeros(0, np.int64)
        x = np.full(len(full), seed, np.uint64)
        for i in range(k):
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[full + i])
        short = np.flatnonzero((n > 0) & (n < k))
        y = np.full(len(short), 0, np.uint64)
        for i in range(k - 1):
            more = n[short] > i
            y[more] = mix(y[more] * np.uint64(0xD6E8FEB86659FD93) + h[first[short[more]] + i] + seed)
    return np.concatenate((x, y)), np.concatenate((row[full], short))


def distinct(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row one after the other, offsets of rows)."""
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    else:
        h = h.copy()
    n = np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(n)))
    # Rows of one size are sorted together; large ones, whose sizes differ, one by one.
    order = np.argsort(n, kind="stable")
    edge = np.flatnonzero(np.diff(n[order], prepend=-1))
    for i, j in zip(edge, np.append(edge[1:], rows)):
        size = n[order[i]] if rows else 0
        if size < 2:
            continue
        if j - i < 3:
            for k in order[i:j]:
                h[at[k] : at[k + 1]].sort()
        else:
            place = at[order[i:j]][:, None] + np.arange(size)
            h[place] = np.sort(h[place], axis=1)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=rows))))


def lists(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
