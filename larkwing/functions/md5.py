"""The first 32 bits of md5(prefix + text) for each of some prefixes and all of a list of texts, on numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_K = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_SHIFTS = np.stack([np.tile(s, 4) for s in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21])]).ravel()
_LEFT, _RIGHT = ([np.array(int(s), np.uint32) for s in x] for x in (_SHIFTS, 32 - _SHIFTS))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Hashes that are made together: enough to outweigh the calls, few enough for the cache.
AT_ONCE = 1 << 14


class Digests:
    """texts: the second halves. After 61 of the 64 steps the first word is known."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], np.int64)
        self.longest, self.words = int(self.sizes.max(initial=0)), {}

    def _words(self, size: int) -> tuple[int, np.ndarray, list]:
        """For prefixes of that many bytes: where the texts' words begin, those words, and each step's word and constant where
        all prefixes have the same."""
        if size not in self.words:
            begin, shift, n = size // 4, size % 4, len(self.texts)
            raw = np.zeros((n, (shift + self.longest + 4) // 4 * 4), np.uint8)
            for i, t in enumerate(self.texts):
                raw[i, shift : shift + len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
            own = np.ascontiguousarray(raw.view("<u4").T)
            steps = []
            for i, w in enumerate(_WORD):
                if w <= begin:  # of the prefix, or of both
                    steps.append(None)
                elif w - begin < len(own) and own[w - begin].any():
                    steps.append(own[w - begin] + _K[i])
                elif w == 14:
                    steps.append(((size + self.sizes) * 8).astype(np.uint32) + _K[i])
                else:
                    steps.append(np.array(_K[i]))
            self.words[size] = begin, own, steps
        return self.words[size]

    def _block(self, prefixes: list[bytes], size: int, low: int, high: int) -> np.ndarray:
        """With the texts from low to high."""
        begin, own, steps = self._words(size)
        n, m = len(prefixes), high - low
        padded = np.frombuffer(b"".join(p.ljust(4 * begin + 4, b"\0") for p in prefixes), "<u4").reshape(n, -1)
        both = own[0, low:high] | padded[:, begin : begin + 1]
        a, b, c, d = (np.full((n, m), v, np.uint32) for v in _START)
        t, u = np.empty((n, m), np.uint32), np.empty((n, m), np.uint32)
        for i in range(61):
            if i < 16:
                np.bitwise_xor(c, d, out=t)
                np.bitwise_and(t, b, out=t)
                np.bitwise_xor(t, d, out=t)
            elif i < 32:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_and(t, d, out=t)
                np.bitwise_xor(t, c, out=t)
            elif i < 48:
                np.bitwise_xor(b, c, out=t)
                np.bitwise_xor(t, d, out=t)
            else:
                np.invert(d, out=t)
                np.bitwise_or(t, b, out=t)
                np.bitwise_xor(t, c, out=t)
            np.add(t, a, out=t)
            w, known = _WORD[i], steps[i]
            if known is not None:
                np.add(t, known[low:high] if known.ndim else known, out=t)
            elif w < begin:
                np.add(t, padded[:, w : w + 1] + _K[i], out=t)
            else:
                np.add(t, both, out=t)
                np.add(t, _K[i], out=t)
            np.left_shift(t, _LEFT[i], out=u)
            np.right_shift(t, _RIGHT[i], out=t)
            np.bitwise_or(t, u, out=t)
            np.add(t, b, out=t)
            a, b, c, d, t = d, t, b, c, a
        np.add(b, np.uint32(_START[0]), out=b)
        return b.byteswap(inplace=True)

    def first_words(self, prefixes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of prefixes, a row of 32-bit numbers for each of these), until all had their turn."""
        sizes = np.array([len(p) for p in prefixes], np.int64)
        step = max(1, AT_ONCE // max(1, len(self.texts)))
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == size)
            for at in range(0, len(of), step):
                part = of[at : at + step]
                own = [prefixes[i] for i in part.tolist()]
                if size + self.longest <= 55:
                    yield part, np.concatenate([self._block(own, size, a, min(a + AT_ONCE, len(self.texts))) for a in range(0, max(1, len(self.texts)), AT_ONCE)], axis=1)
                else:  # more than one block of md5
                    yield part, np.array([[int.from_bytes(hashlib.md5(p + t).digest()[:4], "big") for t in self.texts] for p in own], np.uint32)
