"""Vectorised hashes of words and byte strings.

Polynomial sums modulo 2**64 over scrambled symbols: the sum of a stretch is a difference of prefix sums, shifted to
its start by the inverse power of the (odd) base.
"""

from __future__ import annotations

import numpy as np

from tapelake.llm.simhash import mix

U = np.uint64
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
TABLES = tuple(mix(np.arange(256, dtype=U) * U(0xD6E8FEB86659FD93) + U(k + 1)) for k in range(2))
GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64; kept, and grown on demand."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        size = max(count, 2 * len(have) if have is not None else 4096)
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = have = np.multiply.accumulate(steps)
    return have[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix(symbols: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of symbol * base**position, from 0."""
    out = np.zeros(len(symbols) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * powers(base, len(symbols)), out=out[1:])
    return out


def stretches(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int, base: int) -> np.ndarray:
    """Hashes of the stretches from `start`, of `length` symbols."""
    with np.errstate(over="ignore"):
        raw = sums[start + length] - sums[start]
        return mix(raw * powers(inverse(base), int(start.max()) + 1 if len(start) else 1)[start])


def word_hashes(raw: bytes, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, first and second hash (the second only if `both`) of each word of raw, in stretches that end at a gap."""
    whole = np.frombuffer(raw, np.uint8)
    starts, first, second = [], [], []
    at = 0
    while at < len(whole):
        end = min(len(whole), at + CHUNK)
        while end < len(whole) and not GAPS[whole[end]]:
            end += 1
        part = whole[at:end]
        word = ~GAPS[part]
        begin = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if len(begin):
            stop = np.flatnonzero(word & ~np.r_[word[1:], False]) + 1
            size = stop - begin
            edge = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(edge, size)
            octets = part[word]
            longest = int(size.max())
            with np.errstate(over="ignore"):
                for k, out in enumerate((first, second) if both else (first,)):
                    out.append(mix(np.add.reduceat(TABLES[k][octets] * powers(BASES[k], longest)[place], edge) + size.astype(U)))
            starts.append(begin + at)
        at = end
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(starts, np.int64), join(first, U), join(second, U)
