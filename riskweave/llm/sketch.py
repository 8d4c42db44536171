"""HyperMinHash signatures: a leading-zero count and mantissa bits per bucket, banded and compared.

Every element is thrown into one of the buckets with a 32-bit value, several rounds with new hashes;
a bucket keeps the value of the earliest round that reached it, the smallest of that round. Buckets
that no round reached take the smallest element under a hash of their own. Two sets agree in a bucket
with a probability equal to their Jaccard similarity, also when they have fewer elements than there
are buckets. The value is stored as 16 bits: round (3), leading zeros (5), bits after the leading
one (8).
"""

from __future__ import annotations

import numpy as np

from riskweave.llm.text import mix, owners, seeds

ROUNDS = 7
_MANTISSA = 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_PIECE = 1 << 18


def signatures(hashes: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """uint16 array (texts, buckets) from the element hashes of every text; empty sets are zeros."""
    n = len(first) - 1
    size = np.diff(first)
    best = np.full(n * buckets, _EMPTY, dtype=np.uint64)
    row = owners(first)
    wide = np.uint64(buckets)
    for r, seed in enumerate(seeds(ROUNDS, 11)):
        if r:
            open_row = (best.reshape(n, buckets) == _EMPTY).any(axis=1)
            keep = open_row[row]
            chosen, where = hashes[keep], row[keep]
        else:
            chosen, where = hashes, row
        if not len(chosen):
            break
        x = mix(chosen ^ seed) if r else chosen  # element hashes are mixed already
        slot = where * buckets + (((x >> np.uint64(32)) * wide) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, (x & _LOW) | np.uint64(r << 32))
    empty = np.flatnonzero(best == _EMPTY)
    empty = empty[size[empty // buckets] > 0]
    salts = seeds(buckets, 13)
    cost = np.concatenate([[0], np.cumsum(size[empty // buckets])])
    i = 0
    while i < len(empty):
        j = max(i + 1, int(np.searchsorted(cost, cost[i] + _PIECE, side="right")) - 1)
        part = empty[i:j]
        lengths = size[part // buckets]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.repeat(first[part // buckets] - begin, lengths) + np.arange(lengths.sum())
        x = mix(hashes[at] ^ np.repeat(salts[part % buckets], lengths)) & _LOW
        best[part] = np.minimum.reduceat(x, begin) | np.uint64(ROUNDS << 32)
        i = j
    return _compress(best).reshape(n, buckets)


def _compress(best: np.ndarray) -> np.ndarray:
    value = np.maximum(best & _LOW, np.uint64(1))
    zeros = 31 - np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    after = (value << (zeros + 1).astype(np.uint64)) & _LOW
    mantissa = after >> np.uint64(32 - _MANTISSA)
    turn = np.where(best == _EMPTY, np.uint64(0), best >> np.uint64(32))
    register = (turn << np.uint64(13)) | (zeros.astype(np.uint64) << np.uint64(8)) | mantissa
    return np.where(best == _EMPTY, 0, register).astype(np.uint16)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 array (texts, bands): key of `rows` neighbouring registers (at most four)."""
    parts = signature[:, :bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        key = (key << np.uint64(16)) | parts[:, :, k]
    return mix(mix(key) ^ seeds(bands, 17)[None, :]).view(np.int64)


def _levels(size: np.ndarray, buckets: int) -> np.ndarray:
    """Chance of every (round, leading zeros) of a register, for sets of the given sizes."""
    n = size.astype(np.float64)[:, None]
    high = 2.0 ** -np.arange(32)[None, :]
    low = np.where(np.arange(32) == 31, 0.0, high / 2)
    rounds = []
    for r in range(ROUNDS + 1):
        scale = buckets if r < ROUNDS else 1
        reach = (1 - 1 / buckets) ** (n * r)
        rounds.append(reach * ((1 - low / scale) ** n - (1 - high / scale) ** n))
    return np.concatenate(rounds, axis=1)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of row i of both sides, corrected for registers equal by accident."""
    buckets = a.shape[1]
    equal = (a == b).mean(axis=1)
    chance = (_levels(size_a, buckets) * _levels(size_b, buckets)).sum(axis=1) / 2 ** _MANTISSA
    return (equal - chance) / (1 - chance)
