"""Scalar kernels of the sketches; ``operators.aggregates`` distributes them.

Each sketch is kept as rows that merge by a plain aggregation (largest rank of a
register, count of a bucket, set of bits, sums of exponents), so partial
aggregation runs inside the engine and Python sees single elements or finished
states only.
"""

from __future__ import annotations

from math import floor, inf, log, sqrt

import numpy as np

#: Registers of an HLL: 2^PRECISION.
PRECISION = 12
REGISTERS = 1 << PRECISION
MAX_RANK = 64 - PRECISION + 1
MANTISSA_BITS, MAX_BUCKETS = 7, 2048


def register(h: int) -> tuple[int, int]:
    """Register and rank of a 64-bit hash."""
    low = h & ((1 << (64 - PRECISION)) - 1)
    return h >> (64 - PRECISION), MAX_RANK - low.bit_length()


def hll_estimate(ranks: dict[int, int]) -> int:
    """Ertl's improved estimate; ``ranks``: registers of each rank, those never hit at rank 0."""
    c = [ranks.get(k, 0) for k in range(MAX_RANK + 1)]
    c[0] = REGISTERS - sum(c[1:])
    if c[0] == REGISTERS:
        return 0
    z = REGISTERS * _tau(1 - c[MAX_RANK] / REGISTERS)
    for k in range(MAX_RANK - 1, 0, -1):
        z = (z + c[k]) / 2
    z += REGISTERS * _sigma(c[0] / REGISTERS)
    return round(REGISTERS * REGISTERS / (2 * log(2) * z)) if z < inf else 0


def _sigma(x: float) -> float:
    if x == 1:
        return inf
    total, weight, power = x, 1.0, x
    while True:
        power *= power
        new = total + power * weight
        if new == total:
            return total
        total, weight = new, 2 * weight


def _tau(x: float) -> float:
    if x in (0, 1):
        return 0.0
    total, weight, root = 1 - x, 1.0, x
    while True:
        root, weight = sqrt(root), weight / 2
        new = total - (1 - root) ** 2 * weight
        if new == total:
            return total / 3
        total = new


def bloom_positions(h: int, log2_bits: int, hashes: int) -> list[int]:
    low, high = h & 0xFFFFFFFF, h >> 32 | 1
    return sorted({(low + i * high) % (1 << log2_bits) for i in range(hashes)})


def quantile_index(values: np.ndarray, bits: int = MANTISSA_BITS) -> np.ndarray:
    """Log-linear bucket of each magnitude: binary exponent and first mantissa bits."""
    return (np.abs(values).view(np.uint64) >> np.uint64(52 - bits)).astype(np.int64)


def quantile_midpoint(index: int, bits: int = MANTISSA_BITS) -> float:
    raw = index << (52 - bits) | 1 << (51 - bits)
    return float(np.array(raw, np.uint64).view(np.float64))


def collapsed(store: dict[int, int], most: int = MAX_BUCKETS) -> dict[int, int]:
    """At most ``most`` bucket numbers below the largest stay apart; smaller ones join the last of them."""
    if not store:
        return store
    least = max(store) - most + 1
    out: dict[int, int] = {}
    for i, n in store.items():
        out[max(i, least)] = out.get(max(i, least), 0) + n
    return out


def quantile_of(neg: dict[int, int], zero: int, pos: dict[int, int], q: float, bits: int = MANTISSA_BITS) -> float | None:
    n = sum(neg.values()) + zero + sum(pos.values())
    if not n or not 0 <= q <= 1:
        return None
    rank = min(floor(q * (n - 1)), n - 1)
    steps = [(-quantile_midpoint(i, bits), neg[i]) for i in sorted(neg, reverse=True)] + [(0.0, zero)] + [(quantile_midpoint(i, bits), pos[i]) for i in sorted(pos)]
    for value, count in steps:
        if rank < count:
            return value
        rank -= count
    return None


def float_parts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers m and e with value = m x 2^e, |m| < 2^53, exactly."""
    fraction, exponent = np.frexp(values)
    return (fraction * (1 << 53)).astype(np.int64), exponent.astype(np.int32) - 53


def exact_ratio(top: int, bottom: int) -> float:
    """Correctly rounded top / bottom; beyond all doubles: infinite."""
    try:
        return top / bottom
    except OverflowError:
        return inf if (top > 0) == (bottom > 0) else -inf
