"""Word and shingle hashes of Arrow text columns with numpy: whole texts, no Python loop over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes that are hashed at once; longer texts go through in pieces cut at separators.
PIECE = 1 << 21

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def separators(kind: str) -> np.ndarray:
    """True for bytes between words. "space": words are [^\\x20\\x09-\\x0D]+; "alnum": [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
    (both after lower-casing A-Z)."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:0x30] = out[0x3A:0x61] = out[0x7B:0x80] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE):
    """Row ranges [a, b) of at most limit bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def _words(raw: np.ndarray, cuts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in folded bytes; cuts are offsets at which texts end."""
    inside = ~sep[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    before = np.empty(len(raw), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends


#: Longer words are hashed one by one.
LONG_WORD = 256
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [MASK], np.uint64)


def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes after eight bytes go through the finaliser, all words at once."""
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    if not len(starts):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h ^= eight[starts] & _LOW[np.minimum(sizes, 8)]
    h = mix(h + np.uint64(0x9FB21C651E98DF25))
    at, todo = 8, np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    while len(todo):
        chunk = eight[starts[todo] + at] & _LOW[np.minimum(sizes[todo] - at, 8)]
        h[todo] = mix((h[todo] ^ chunk) + np.uint64(0x9FB21C651E98DF25))
        at += 8
        todo = todo[sizes[todo] > at]
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words in each text. raw is unfolded."""
    raw = FOLD[raw]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _words(raw, offsets, sep)
    return _hash(raw, starts, ends), np.diff(np.searchsorted(starts, offsets))


_STEPS = mix(np.arange(1, 4096, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words of one text, in order; a shorter text that has words is one run."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(size))
        for j in range(size):
            total += words[j : j + n] * _STEPS[j]
    return mix(total)


def all_shingles(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts at once: hashes, one text after the other, and how many each text has."""
    n = np.where(counts > 0, np.maximum(counts - size, 0) + 1, 0)
    ends, cuts = np.cumsum(counts), np.cumsum(n)
    # runs from every word on, those that reach into the next text too; these are left out
    total = np.full(max(0, len(words) - size + 1), np.uint64(size))
    for j in range(size):
        total += words[j : j + len(total)] * _STEPS[j]
    first = np.zeros(len(words), bool)
    first[np.arange(cuts[-1] if len(cuts) else 0) + np.repeat(ends - counts - (cuts - n), n)] = True
    whole = first[: len(total)]
    out = np.empty(int(n.sum()), np.uint64)
    if len(short := np.flatnonzero((counts > 0) & (counts < size))):
        first[(ends - counts)[short]] = False
        long = np.ones(len(out), bool)
        long[cuts[short] - 1] = False
        out[long] = mix(total[whole])
    else:
        out = mix(total[whole])
    for i in short.tolist():
        out[cuts[i] - 1] = shingles(words[ends[i] - counts[i] : ends[i]], size)[0]
    return out, n
