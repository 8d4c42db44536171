"""Periodic runs of words by suffix trees, and texts with every run cut down to its first period.

A run is a maximal stretch of words with smallest period q that is long enough. Every run is found
from a Lyndon root: for one of the two orders of the alphabet, the longest Lyndon word at some place
of the run is one period long. So for each place and both orders the longest Lyndon word [i, j) is a
candidate with period j - i; it ends at the next place whose suffix is smaller. The candidate is
extended to the right by the longest common extension (LCE) of the suffixes at i and j and to the left
by that of the reversed prefixes, and is a run if it is long enough. LCEs are depths of lowest common
ancestors in the suffix trees (built by Ukkonen's algorithm) of the words and of their reversal: an
Euler tour turns an ancestor into a range minimum, answered in constant time from a sparse table.

A run holds each of its windows of `WINDOW` words twice, a period apart. Only stretches in which every
window occurs twice in the text are therefore given to the trees; no run is lost and other words cost
no more than their hash. Time and memory are linear in the longest such stretch (n log n numbers).

Words are maximal runs outside \\x20 and \\x09-\\x0D, compared as bytes. Defined cases: a null text counts
as empty and has no runs; rows with null or repeated doc_id are judged by their own text; an empty
table gives an empty result. Overlapping runs are all reported; a word goes if any of them holds it
after its first period. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import text

#: A run has at least MIN_WORDS words and MIN_PERIODS periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Every window of so many words in a run occurs in it again, one period before or after.
WINDOW = 8


class SuffixTree:
    """Suffix tree of a sequence of positive numbers, closed by a 0."""

    def __init__(self, codes: list[int]):
        self.codes = codes = [*codes, 0]
        n = len(codes)
        # per node: begin and end of the edge above it, children by first number (None: a leaf)
        begin, end, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = edge = length = waiting = leaves = 0
        for i, c in enumerate(codes):
            waiting += 1
            fresh = 0  # inner node of this step that has no suffix link yet
            while waiting:
                if not length:
                    edge = i
                below = kids[node].get(codes[edge])
                if below is None:
                    kids[node][codes[edge]] = len(begin)
                    if fresh:
                        link[fresh], fresh = node, 0
                else:
                    span = (i + 1 if kids[below] is None else end[below]) - begin[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if codes[begin[below] + length] == c:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    inner = len(begin)
                    kids[node][codes[edge]] = inner
                    begin.append(begin[below])
                    begin[below] += length
                    end.append(begin[below])
                    link.append(0)
                    suffix.append(-1)
                    kids.append({c: inner + 1, codes[begin[below]]: below})
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                begin.append(i)
                end.append(n)
                link.append(0)
                kids.append(None)
                suffix.append(leaves)  # leaves are made in the order of their suffixes
                leaves += 1
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._begin, self._end, self._kids, self._suffix = begin, end, kids, suffix

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of an Euler tour, and the least depth passed before each.

        Numbers ascend, or descend if `backwards`; the closing 0 comes first either way. A node is
        passed between its children, so the least depth between two leaves is that of their lowest
        common ancestor; of the passings between neighbouring leaves only that one is kept.
        """
        begin, end, kids, suffix = self._begin, self._end, self._kids, self._suffix
        order, least = [], []
        stack = [(0, 0, 0)]  # node, depth above its edge, least depth since the leaf before
        while stack:
            node, depth, low = stack.pop()
            below = kids[node]
            if below is None:
                order.append(suffix[node])
                least.append(low)
                continue
            depth += end[node] - begin[node]
            # last child first, so that the first one is on top
            names = sorted(below, reverse=not backwards)
            if backwards and names[0] == 0:
                names.append(names.pop(0))
            for name in names:
                stack.append((below[name], depth, depth))
            stack[-1] = (below[names[-1]], depth, low)
        return np.array(order, np.int64), np.array(least, np.int32)


class Extensions:
    """Constant-time longest common extensions of two suffixes, from a tree's Euler tour."""

    def __init__(self, order: np.ndarray, least: np.ndarray):
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self._table = [least]
        while 2 << len(self._table) - 1 <= len(least):
            last, step = self._table[-1], 1 << len(self._table) - 1
            self._table.append(np.minimum(last[:-step], last[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b (different places)."""
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self._table[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place but the last, the next place with a smaller rank; the last has the least."""
    ranks, stack = rank.tolist(), []
    out = [0] * (len(ranks) - 1)
    for j, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = j
        if j < len(out):
            stack.append(j)
    return np.array(out, np.int64)


def runs_of(codes: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
            ) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of positive numbers, by start and period.

    min_periods must be 2 at least.
    """
    n = len(codes)
    if n < max(min_words, 2):
        return []
    tree = SuffixTree(codes)
    order, least = tree.tour()
    other, _ = tree.tour(backwards=True)
    del tree
    right = Extensions(order, least)
    rank = np.empty(n + 1, np.int64)
    rank[other] = np.arange(n + 1)
    left = Extensions(*SuffixTree(codes[::-1]).tour())
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(right.place), next_smaller(rank)])
    before, after = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    inner = np.flatnonzero(i > 0)
    before[inner] = left.common(n - i[inner], n - j[inner])
    inner = np.flatnonzero(j < n)
    after[inner] = right.common(i[inner], j[inner])
    period, start, stop = j - i, i - before, j + after
    long = np.flatnonzero((stop - start >= min_words) & (stop - start >= min_periods * period))
    found = set(zip(start[long].tolist(), period[long].tolist(), (stop - start)[long].tolist()))
    return [(s, length, p) for s, p, length in sorted(found)]


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the longest stretches of words all of whose windows occur twice or more."""
    whole, _ = text.windows(hashes, np.array([0, len(hashes)]), WINDOW)
    least = MIN_WORDS - WINDOW + 1
    if len(whole) < least:
        return []
    ordered = np.sort(whole)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    twice = np.zeros(len(whole) + 2, np.int8)
    twice[1:-1] = np.isin(whole, again)
    edges = np.diff(twice)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(a, b + WINDOW - 1) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= least]


def text_runs(words: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run among the words."""
    found = []
    for a, b in stretches(hashes):
        names: dict[bytes, int] = {}
        codes = [names.setdefault(w, len(names) + 1) for w in words[a:b]]
        found += [(a + s, length, p) for s, length, p in runs_of(codes)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


#: Says which word of a text stands at each place, from doc_id and the number of words; None: as is.
Edit = Callable[[int | None, int], np.ndarray | None]
SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "collapsed string")
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def with_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every whole text by start and period, and the
    words that stay joined by one space; `edit` rearranges the words of a text first."""
    def run(batches):
        for batch in batches:
            for row, data, offsets in text.slices(batch.column(1)):
                starts, ends, first = text.words(data, offsets)
                hashes = text.span_hashes(data, starts, ends)
                raw, bounds = data.tobytes(), offsets.tolist()
                ids = batch.column(0).slice(row, len(offsets) - 1)
                counts, found, left = [], [], []
                for k, doc in enumerate(ids.to_pylist()):
                    words = raw[bounds[k]:bounds[k + 1]].split()
                    own = hashes[first[k]:first[k + 1]]
                    order = edit(doc, len(words)) if edit else None
                    if order is not None:
                        own, words = own[order], [words[i] for i in order.tolist()]
                    runs = text_runs(words, own)
                    counts.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    left.append(b" ".join(collapsed(words, runs)).decode())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)),
                     pa.array(left, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, SCHEMA)


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """Tile the end of one text in ten, by the crc32 of its doc_id; a null doc_id stays as it is."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    a = h // 10 % n
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % (1 + (n - a) // (3 + h // 10 % 8)))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent, and digests of the runs and of the text left."""
    best = F.array_sort("runs", lambda x, y: F.when(
        x["length"] * y["period"] != y["length"] * x["period"],
        F.signum(y["length"] * x["period"] - x["length"] * y["period"])).when(
        x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
        F.signum(x["period"] - y["period"])).cast("int"))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(best, F.lit(0)).alias("best_"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words").select(
        "doc_id", "n_runs", *[F.col(f"best_.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best_.length) div best_.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256", "n_words")
