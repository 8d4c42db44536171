"""Words, windows and their hashes for whole Arrow text columns, without an object per word.

White space is the six ASCII characters \\x20 and \\x09-\\x0D and folding touches A-Z only, so both can
be done on UTF-8 bytes. Hashes are 64-bit: a polynomial in an odd base modulo 2^64 over the bytes of
a span, then a mixing step; equal spans have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Constants of the splitmix64 finaliser and of the polynomial.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_BLOCK = 1 << 18
#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of every element."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(n, dtype=np.uint64) + np.uint64(salt) * np.uint64(0x100000001B3))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span; starts and ends must not decrease."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = int(np.searchsorted(starts, low + _BLOCK))
        high = ends[j - 1]
        up, down = _power_tables(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low],
                  out=sums[1:])
        begin = starts[i:j] - low
        out[i:j] = (sums[ends[i:j] - low] - sums[begin]) * down[begin]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * _GOLDEN))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows that together have about `limit` bytes."""
    data, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; text i has words first[i]:first[i + 1]."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """Row of every element, from the n + 1 offsets of rows into elements."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 7
            ) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every window of `size` consecutive elements of one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(seeds(size, salt)):
        total += hashes[k:k + n] * (c | np.uint64(1))
    row = owners(first)
    at = np.flatnonzero(row[:n] == row[size - 1:])
    return mix(total[at]), at


def line_forms(data: np.ndarray, offsets: np.ndarray):
    """Lines with a word of folded texts: (row, number, id, tail, forms).

    A line's form is its words joined by one blank; id and tail are the halves of its 128-bit digest.
    Most texts have no other white space than single blanks and line feeds; only the others are
    split into words.
    """
    rows, numbers, forms = [], [], []
    if len(data):
        blank, space = data == 32, SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        beside = edge[:-1] | edge[1:]
        beside[1:] |= space[:-1]
        beside[:-1] |= space[1:]
        odd = np.concatenate([[0], np.cumsum((space & ~blank & (data != 10)) | (blank & beside))])
        raw = data.tobytes()
        bounds, odd = offsets.tolist(), (np.diff(odd[offsets]) > 0).tolist()
        for i, messy in enumerate(odd):
            for n, line in enumerate(raw[bounds[i]:bounds[i + 1]].split(b"\n")):
                if messy:
                    line = b" ".join(line.split())
                if line:
                    rows.append(i)
                    numbers.append(n)
                    forms.append(line)
    digest = np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in forms]),
                           dtype=np.int64).reshape(-1, 2)
    return np.array(rows, np.int64), np.array(numbers, np.int64), digest[:, 0], digest[:, 1], forms


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct folded word shingles of every text: (sorted hashes, n + 1 offsets of the texts).

    A text with fewer words than `size` has its whole word sequence as its only shingle; one
    without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    whole, at = windows(hashed, first, size)
    begin = np.searchsorted(at, first)
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(counts)):
        n = first[i + 1] - first[i]
        if n >= size:
            found = np.unique(whole[begin[i]:begin[i + 1]])
        elif n:
            found = windows(hashed[first[i]:first[i + 1]], np.array([0, n]), int(n), 100 + int(n))[0]
        else:
            continue
        counts[i] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64),
            np.concatenate([[0], np.cumsum(counts)]))


def char_shingles(data: np.ndarray, offsets: np.ndarray, size: int, distinct: bool = True
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of `size` code points of every text; a shorter text is its own shingle."""
    begins = (data & 0xC0) != 0x80  # first bytes of UTF-8 characters
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    ascii_only = bool(begins.all())
    starts = None if ascii_only else np.flatnonzero(begins)
    at = offsets if ascii_only else np.searchsorted(starts, offsets)  # in characters
    length = np.diff(at)
    long = length >= size
    counts = np.where(long, length - size + 1, (length > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    whole = np.ones(max(int(at[-1]) - size + 1, 0), dtype=bool)
    for k in range(1, size):  # windows that would reach into the next text
        ends = at[1:] - k
        whole[ends[(ends >= 0) & (ends < len(whole))]] = False
    hashed = np.empty(first[-1], dtype=np.uint64)
    is_long = np.repeat(long, counts)
    if not len(whole):
        pass
    elif ascii_only:
        hashed[is_long] = _window_hashes(data, size)[whole]
    else:
        edges = np.append(starts, len(data))
        hashed[is_long] = span_hashes(data, starts[:len(whole)][whole], edges[size:][whole])
    if not long.all():
        short = np.flatnonzero((length > 0) & ~long)
        hashed[~is_long] = span_hashes(data, offsets[short], offsets[short + 1])
    if not distinct:
        return hashed, first
    out = [np.unique(hashed[a:b]) for a, b in zip(first[:-1], first[1:])]
    counts = np.array([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else hashed), np.concatenate([[0], np.cumsum(counts)])


def _window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash that ``span_hashes`` gives to every window of `size` bytes."""
    out = np.empty(len(data) - size + 1, dtype=np.uint64)
    for low in range(0, len(out), _BLOCK):
        n = min(_BLOCK, len(out) - low)
        up, down = _power_tables(n + size)
        part = data[low:low + n + size - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        out[low:low + n] = (sums[size:size + n] - sums[:n]) * down[:n]
    with np.errstate(over="ignore"):
        return mix(out ^ (np.uint64(size) * _GOLDEN))


def intersections(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the sets of row i in both sides."""
    common = np.array([len(np.intersect1d(a[0][a[1][i]:a[1][i + 1]], b[0][b[1][i]:b[1][i + 1]],
                                          assume_unique=True)) for i in range(len(a[1]) - 1)],
                      dtype=np.int64)
    return common, np.diff(a[1]) + np.diff(b[1]) - common
