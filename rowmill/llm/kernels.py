"""Vectorised text kernels that run inside tasks, one document at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D, so every kernel works on UTF-8
bytes. Hashes are 64-bit: a polynomial prefix sum modulo 2**64 gives the hash of any run of units
in constant time, and a finaliser spreads it.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_NO_HASHES = np.zeros(0, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: One random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n at least."""
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class RunHasher:
    """Hashes of any runs of a sequence of 64-bit unit values."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        powers, self.inverse = _powers_to(n)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(units * powers[:n], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h ^ (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def grams(self, k: int) -> np.ndarray:
        """Of every run of k units, by its start."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return _NO_HASHES
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    space = SPACE[data]
    if not len(space):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(space[1:] != space[:-1])
    at += 1
    if not space[0]:
        at = np.insert(at, 0, 0)
    if not space[-1]:
        at = np.append(at, len(space))
    return at[0::2], at[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RunHasher(BYTE_VALUES[data]).runs(starts, ends)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lower-cased; one shingle of all
    words if there are fewer than size, none without words."""
    data = LOWER[as_bytes(text)]
    starts, ends = word_spans(data)
    if len(starts) == 0:
        return _NO_HASHES
    hasher = RunHasher(word_hashes(data, starts, ends))
    return np.unique(hasher.grams(min(size, len(starts))))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(U64).max, dtype=U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def owned_windows(units: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Winnowing that accounts for every window of `window` units.

    A window's anchor is its least k-gram by hash, the leftmost of equal ones; it depends on nothing
    outside the window, so equal windows have equal anchors at equal offsets. Consecutive windows
    with one anchor form a run. Returns for each run: the anchor's hash, the hash of the run's
    whole context (with the anchor's place in it), the first window, the number of windows and the
    anchor's place.
    """
    m = len(units) - window + 1
    if m <= 0:
        none = np.zeros(0, dtype=np.int64)
        return _NO_HASHES, _NO_HASHES, none, none, none
    hasher = RunHasher(units)
    grams = hasher.grams(k)
    low = U64(0xFFFFFFFF)
    keys = (grams & ~low) | np.arange(len(grams), dtype=U64)
    owner = (sliding_min(keys, window - k + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    count = np.diff(first, append=m)
    at = owner[first]
    context = hasher.runs(first, first + count - 1 + window)
    return grams[at], mix(context ^ (at - first).astype(U64)), first, count, at


def covered(starts: np.ndarray, counts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n units lie in any of the windows starts[i] .. starts[i] + counts[i] - 1."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(starts + counts - 1 + window, n), -1)
    return np.cumsum(steps[:n]) > 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
