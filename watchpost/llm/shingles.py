"""Word shingles of whole texts as sets of 64-bit hashes, their MinHash values and odd sketches."""

from __future__ import annotations

import numpy as np

from .common import SPACED, Words, mix

SHINGLE = 5
HASHES = 384
#: the most a pair at the threshold may be missed with
MISSED = 2.5e-7
SKETCH_BITS = 2048

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LINE = np.arange(1, HASHES + 1, dtype=np.uint64)
_FLIPS = (mix(_LINE * _STEP) >> np.uint64(32)).astype(np.uint32)
_TIMES = (mix(_LINE + _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    A text of fewer than five words has the whole sequence as its only shingle, one without words
    has none.
    """
    w = Words(texts, SPACED)
    h, out, low = w.hashes, [], 0
    five = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        five = five * _STEP + h[k : len(h) - SHINGLE + 1 + k]
    five = mix(five)
    for high in w.ends.tolist():
        n = high - low
        if n >= SHINGLE:
            out.append(np.unique(five[low : high - SHINGLE + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for value in h[low:high]:
                    whole = whole * _STEP + value
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        low = high
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """``HASHES`` 32-bit minima over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = None
    for at in range(0, x.shape[1], 512):
        block = ((x[:, at : at + 512] ^ _FLIPS[:, None]) * _TIMES[:, None]).min(1)
        best = block if best is None else np.minimum(best, block)
    return best


def bands_for(percent: int) -> int:
    """The fewest bands in which a pair at ``percent`` is missed with at most ``MISSED``."""
    bands = [b for b in range(1, HASHES + 1) if HASHES % b == 0]
    found = [b for b in bands if missed(percent, b) <= MISSED]
    return found[0] if found else HASHES


def missed(percent: int, bands: int) -> float:
    """The probability with which a pair of this similarity shares no band."""
    return (1 - (percent / 100) ** (HASHES // bands)) ** bands


def band_keys(mins: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each run of ``HASHES / bands`` minima."""
    rows = mins.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * _STEP + rows[:, k])
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    if not len(shingles):
        return b""
    a, b = mix(shingles).sum(), mix(shingles ^ _STEP).sum()
    return a.tobytes() + b.tobytes()


def odd_sketch(mins: np.ndarray) -> bytes:
    """Parities of how many (place, minimum) pairs fall on each of ``SKETCH_BITS`` bits."""
    at = mix(_LINE * _STEP ^ mins.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def estimated_similarity(different_bits: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    share = np.minimum(2.0 * different_bits / SKETCH_BITS, 0.999)
    different = -SKETCH_BITS / 2 * np.log1p(-share)
    return 1 - different / (2 * HASHES)
