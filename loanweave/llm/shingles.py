"""Hashed word shingles of whole texts, for many texts at once with numpy.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case.
A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums; a shingle's hash
combines those of its words in order. A text of fewer words than a shingle has one shingle of all
its words.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LONGEST_JOIN = 1 << 19  # bytes hashed at once; a longer text is hashed alone

_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
_WORD[128:] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, LONGEST_JOIN + 1), base, np.uint64)
        known[0] = 1
        _powers[name] = known = np.multiply.accumulate(known)
    return known


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text) in order."""
    joined = "\0".join([t.replace("\0", " ") if t else "" for t in texts]).lower().encode()
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, len(data) + 1)[: len(data)],
              out=sums[1:])
    hashes = (sums[end] - sums[begin]) * _power("down", INVERSE, len(data) + 1)[begin]
    text = np.searchsorted(np.flatnonzero(data == 0), begin)
    return mixed(hashes), text


def shingles_of(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The shingle hashes of each text, in order of its words."""
    if len(texts) > 1 and sum(len(t or "") for t in texts) > LONGEST_JOIN:
        half = len(texts) // 2
        return shingles_of(texts[:half], size) + shingles_of(texts[half:], size)
    words, text = words_of(texts)
    n = len(words)
    padded, owner = np.append(words, np.zeros(size, np.uint64)), np.append(text, np.full(size, -1))
    total = np.zeros(n, np.uint64)
    for j in range(size):
        same = owner[j : j + n] == text
        total = total * BASE + np.where(same, padded[j : j + n], np.uint64(0))
    whole = owner[size - 1 : size - 1 + n] == text
    first = np.append(True, text[1:] != text[:-1])[:n] if n else np.zeros(0, bool)
    kept = whole | first
    ends = np.searchsorted(text[kept], np.arange(len(texts)), side="right")
    return np.split(mixed(total[kept]), ends[:-1])
