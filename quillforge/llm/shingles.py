"""Word shingles of texts as sorted 64-bit hashes, and one-permutation MinHash bands over them.

All of a batch's bytes are hashed at once in numpy; rows only matter for the cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bins of one signature, taken as BANDS bands of ROWS bins. A pair at similarity 0.8 shares no band
#: with probability (1 - 0.8 ** 8) ** 80 = 4e-7; one at 0.5 shares 0.3 bands, one at 0.3 0.005.
BANDS, ROWS = 80, 8
BINS = BANDS * ROWS

_rng = np.random.default_rng(20_240_611)
_LETTER = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _TABLES[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (bytes other than white space, A-Z lower-cased) and the row each is in."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)  # a row's first byte starts a word, whatever the row before ends with
    edge[offsets[:-1]] = True
    word = ~space
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    power, inverse = _tables(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_LETTER[_LOWER[data]] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    With fewer than k words the whole sequence is the one shingle; without words the set is empty.
    """
    words, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(rows, np.arange(n + 1))
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        total += words[i : i + len(total)] * _PLACE[i]
    total = mix(total)
    for r in range(n):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= k:
            got = np.sort(total[a : b - k + 1])
            if len(got) > 1:
                got = got[np.concatenate(([True], got[1:] != got[:-1]))]
            yield got
        elif b > a:
            few = words[a:b]
            yield mix((few * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield total[:0]


#: Columns of the order that are looked at together while bins are filled.
_AT_ONCE = 16
#: Row i lists all bins in the order in which bin i looks for a value, one fixed permutation a bin. So every
#: search ends, and a set of one shingle is densified like any other.
_ORDER = np.argsort(
    mix(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(BINS, dtype=np.uint64)[None] * np.uint64(7_919) + np.uint64(1)), axis=1
).astype(np.int16)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)  # where in row i's order a bin stands
_BAND_PLACE = _rng.integers(1, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))


def bands(values: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set that isn't empty.

    One permutation: a value's bin is where its hash lies, and the bin keeps its least hash. An empty
    bin takes the value of the first bin that isn't empty in a random order of its own, which is the
    same for all sets (optimal densification: each full bin is as likely, independently for each bin).
    """
    hashed = np.sort(mix(values ^ np.uint64(0x5851F42D4C957F2D)))
    at = (hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)  # ascending with the hash
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    bins = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    bins[at[first].astype(np.int64)] = hashed[first]
    full[at[first].astype(np.int64)] = True
    if not full.all():
        bins_full, empty = np.flatnonzero(full), np.flatnonzero(~full)
        if len(bins_full) <= _AT_ONCE:
            source = bins_full[_RANK[np.ix_(empty, bins_full)].argmin(axis=1)]
        else:
            source = np.full(len(empty), -1)
            left = np.arange(len(empty))
            for t in range(0, BINS, _AT_ONCE):
                tried = _ORDER[empty[left], t : t + _AT_ONCE]
                hit = full[tried]
                pick = hit.argmax(axis=1)
                done = hit[np.arange(len(left)), pick]
                source[left[done]] = tried[done, pick[done]]
                left = left[~done]
                if not len(left):
                    break
        bins[empty] = bins[source]
    rows = bins.reshape(BANDS, ROWS)
    return mix((rows * _BAND_PLACE).sum(axis=1, dtype=np.uint64) ^ _BAND)


#: Sets of at most ``TINY`` shingles, and those that they can be linked with, also get exact keys.
TINY = 16


def exact_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two small sets share one wherever 100 * intersection >= percent * union; none for larger sets.

    Small sets fill few bins, so their bands aren't independent. Their first ``n - ceil(p n) + 1`` shingles in
    one fixed order are keys instead: linked sets always share one of these.
    """
    n = len(values)
    if n * percent > TINY * 100:
        return values[:0]
    spread = np.sort(mix(values ^ np.uint64(0x2545F4914F6CDD1D)))
    return mix(spread[: n - -(-percent * n // 100) + 1] ^ np.uint64(0xD6E8FEB86659FD93))


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
