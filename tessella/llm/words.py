"""Words of a text as 64-bit hashes, by numpy on the text's bytes: no Python object per word."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: A-Z to lower case, what is no ASCII letter or digit to a blank; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


PIECE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 2 * len(_powers[kind]), 1 << 16)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def spans(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-blank bytes."""
    edge = np.diff(np.concatenate(([0], (folded != 32).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """One hash per word of the lower-cased text; a word is a run of letters, digits or characters
    beyond ASCII. Linear in the text's length."""
    data = text.lower().encode("utf-8", "replace").translate(FOLD)
    parts, at = [], 0
    while at < len(data):  # pieces end at a blank, so that arrays stay small for any text
        end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        parts.append(_hashes(np.frombuffer(data[at : end if end >= 0 else None], np.uint8)))
        at = end if end >= 0 else len(data)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hashes(folded: np.ndarray) -> np.ndarray:
    starts, ends = spans(folded)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * _power("up", len(folded))[: len(folded)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * _power("down", len(folded))[starts])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words in text order; a shorter text that has words is one run."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : n - k + 1 + j]
    return mixed(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash joined with its occurrence number (0, 1, ...), so that none repeats."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, bool)
    if fresh.all():
        return hashes
    at = np.arange(len(ranked))
    seen = np.empty(len(ranked), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(seen > 0, mixed(hashes + seen * _INVERSE), hashes)
