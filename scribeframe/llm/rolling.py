"""Rolling k-gram hashes and window minima over whole sequences, vectorised."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = 24
_POSITIONS = (1 << _POSITION_BITS) - 1
#: Positions per block, so that a position within a block fits its bits.
BLOCK = 1 << 20

_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive codes; equal k-grams hash alike anywhere."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    out = []
    for at in range(0, n - k + 1, BLOCK):
        part = codes[at : at + BLOCK + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers_of(_BASE, len(part)), out=sums[1:])
        count = len(part) - k + 1
        out.append(_mix((sums[k:] - sums[:count]) * _powers_of(_INVERSE, count)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def window_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that hold the minimum of some window, the rightmost of ties, ascending,
    and for each the first window that it is the minimum of.

    Windows of one minimum are consecutive and end where the next minimum's
    begin. The order compares the upper 40 bits of the hashes. Fewer hashes
    than a window count as one window.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    window = min(window, n)
    found, firsts = [], []
    for at in range(0, n - window + 1, BLOCK):
        part = hashes[at : at + BLOCK + window - 1]
        spots = np.arange(len(part), dtype=np.uint64)
        least = (part & ~np.uint64(_POSITIONS)) | (np.uint64(_POSITIONS) - spots)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            count = len(part) - window + 1
            least = np.minimum(least[:count], least[window - width :][:count])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        found.append(at + (_POSITIONS - (least[first] & np.uint64(_POSITIONS)).astype(np.int64)))
        firsts.append(at + first)
    if len(found) == 1:
        return found[0], firsts[0]
    # A run over a block's edge was found twice.
    positions, at = np.unique(np.concatenate(found), return_index=True)
    return positions, np.concatenate(firsts)[at]


def sampled(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window_runs`` of the k-gram hashes of a sequence, and the chosen hashes.

    A long sequence goes block by block, so beyond the codes only what was
    chosen is held at once.
    """
    count = len(codes) - k + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    window = min(window, count)
    parts = []
    for at in range(0, count - window + 1, BLOCK):
        hashes = kgram_hashes(codes[at : at + BLOCK + window + k - 2], k)
        positions, firsts = window_runs(hashes, window)
        parts.append((at + positions, at + firsts, hashes[positions]))
    if len(parts) == 1:
        return parts[0]
    positions, firsts, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    # A run over a block's edge was found twice.
    positions, at = np.unique(positions, return_index=True)
    return positions, firsts[at], hashes[at]


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """The positions of ``window_runs``."""
    return window_runs(hashes, window)[0]
