"""Deterministic pseudo-random integers keyed by row, stable under any partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 2.0 ** 63
# Fixed values of a multiplicative generator whose arithmetic any SQL engine reproduces exactly.
MODULUS = 2147483647
MULTIPLIER = 48271
_STEP, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def strong_hash(*cols: Column, seed: int = 42) -> Column:
    """Non-negative 63-bit integer."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 1)


def strong_uniform(*cols: Column, seed: int = 42) -> Column:
    return strong_hash(*cols, seed=seed) / F.lit(HASH_SPACE)


def portable_hash(row: Column, draw: Column | int = 0, seed: int = 42) -> Column:
    """Integer in [0, MODULUS) from plain integer arithmetic.

    Weaker than ``strong_hash``; it exists so that another engine can repeat the same draws.
    """
    draw = F.lit(draw) if isinstance(draw, int) else draw
    first = F.pmod(row.cast("long") * 7919 + draw.cast("long") * 104729 + seed, F.lit(MODULUS))
    squared = F.pmod(first * first + 12345, F.lit(MODULUS))
    return F.pmod(squared * MULTIPLIER, F.lit(MODULUS))


def portable_uniform(row: Column, draw: Column | int = 0, seed: int = 42) -> Column:
    return portable_hash(row, draw, seed) / F.lit(float(MODULUS))


def portable_draws(rows: np.ndarray, draws: np.ndarray, seed: int = 42) -> np.ndarray:
    """``portable_uniform`` of every row (down) and draw (across) as a matrix."""
    modulus, shift = np.uint64(MODULUS), np.uint64(31)
    row = ((rows.astype(np.int64) * 7919 + seed) % MODULUS).astype(np.uint64)
    draw = (draws.astype(np.int64) * 104729 % MODULUS).astype(np.uint64)
    x = row[:, None] + draw[None, :]
    # the modulus is 2^31 - 1: the upper bits are added to the lower ones instead of a division
    x -= modulus * (x >= modulus)
    x *= x
    x += np.uint64(12345)
    upper = x >> shift
    x &= modulus
    x += upper
    x *= np.uint64(MULTIPLIER)
    np.right_shift(x, shift, out=upper)
    x &= modulus
    x += upper
    np.subtract(x, modulus, out=upper)  # wraps to a large number where x is already below
    np.minimum(x, upper, out=x)
    return x / float(MODULUS)


def strong_draws(rows: np.ndarray, draws: np.ndarray, seed: int = 42) -> np.ndarray:
    """Numbers in [0, 1) for every row (down) and draw (across), from a 64-bit mixing function."""
    row = _mixed(rows.astype(np.int64).view(np.uint64) + np.uint64(seed * _STEP & _WORD))
    draw = _mixed(draws.astype(np.uint64) * np.uint64(_STEP) + np.uint64(1))
    x = row[:, None] + draw[None, :]
    return (_mixed(x) >> np.uint64(11)) * 2.0 ** -53


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a splitmix generator, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
