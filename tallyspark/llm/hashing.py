"""Vectorised 64-bit hashing of bytes, words and shingles."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 1 << 20


class Powers:
    """Powers of the base and of its inverse modulo 2**64, extended when a longer piece comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]) for base in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray, letters: np.ndarray = _LETTER) -> np.ndarray:
    """Polynomial prefix hashes: entry i covers data[:i]."""
    up, _ = POWERS.upto(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(letters[data] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span lies."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _pieces(data: np.ndarray):
    """The bytes in pieces that end at a blank, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + _STEP, len(data))
        if end < len(data):
            blank = np.flatnonzero(_BLANK[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                rest = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[at:end]
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without blanks, A-Z in lower case), in order."""
    out = []
    for piece in _pieces(np.frombuffer(text, np.uint8)):
        edge = np.diff(np.concatenate([[False], ~_BLANK[piece], [False]]).astype(np.int8))
        out.append(span_hashes(prefix_sums(_FOLD[piece]), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words; all words as one if there are fewer; empty without words."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total = mix(total * _BASE + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(total)
