"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Every rule is a test on whole texts. Its cost (seconds per text) and selectivity (share of texts it
rejects) are estimated on a sample; rules then run in falling order of selectivity / cost, each only
on the texts that all rules before it kept. The order changes the work, never a verdict: a text is
kept when no rule rejects it.

Words are maximal runs outside \\x20 and \\x09-\\x0D. Defined cases: a null text counts as empty, has no
words and is rejected by the word minimum; rows with null or repeated doc_id are judged by their own
text; an empty table gives an empty result, and an empty sample the order in which rules are listed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import text

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8


class Slice:
    """Statistics of consecutive texts, each computed when a rule first asks for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._made: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def subset(self, keep: np.ndarray) -> "Slice":
        """The texts marked in keep."""
        length = np.diff(self.offsets)
        out = Slice(self.data[np.repeat(keep, length)],
                    np.concatenate([[0], np.cumsum(length[keep])]))
        for name, value in self._made.items():
            if not name.startswith("_"):
                out._made[name] = value[keep]
        return out

    def stat(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, "_" + name)()
        return self._made[name]

    def _spans(self):
        if "_spans" not in self._made:
            self._made["_spans"] = text.words(self.data, self.offsets)
        return self._made["_spans"]

    def _hashes(self):
        if "_hashes" not in self._made:
            starts, ends, _ = self._spans()
            self._made["_hashes"] = text.span_hashes(self.data, starts, ends)
        return self._made["_hashes"]

    def _count(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _n_words(self):
        return np.diff(self._spans()[2])

    def _word_chars(self):
        # continuation bytes of UTF-8 do not start a code point
        return self._count(~text.SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self):
        return self._count(SYMBOLS[self.data])

    def _n_bangs(self):
        return self._count(self.data == ord("!"))

    def _n_lines(self):
        return self._line_counts()[0]

    def _n_dup_lines(self):
        return self._line_counts()[1]

    def _line_counts(self):
        if "_line_counts" not in self._made:
            breaks = np.flatnonzero(self.data == 10)
            inner = self.offsets[:-1][np.diff(self.offsets) > 0]
            starts = np.union1d(inner, breaks + 1)
            starts = starts[starts < len(self.data)]
            ends = np.minimum(np.append(starts[1:], len(self.data)), len(self.data))
            at_break = np.isin(ends - 1, breaks)
            ends = ends - (at_break & (ends > starts))
            word_starts = self._spans()[0]
            full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
            starts, ends = starts[full], ends[full]
            row = np.searchsorted(self.offsets, starts, side="right") - 1
            seen = np.stack([row.astype(np.uint64),
                             text.span_hashes(self.data, starts, ends)], axis=1)
            order = np.lexsort((seen[:, 1], seen[:, 0]))
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (seen[order][1:] == seen[order][:-1]).all(axis=1)
            self._made["_line_counts"] = (
                np.bincount(row, minlength=len(self)),
                np.bincount(row[order][again], minlength=len(self)))
        return self._made["_line_counts"]

    def _n_repeat_words(self):
        first = self._spans()[2]
        hashed, at = text.windows(self._hashes(), first, WINDOW)
        out = np.zeros(len(self), dtype=np.int64)
        begin = np.searchsorted(at, first)
        for i in np.flatnonzero(begin[1:] > begin[:-1] + 1):
            own = hashed[begin[i]:begin[i + 1]]
            order = np.argsort(own, kind="stable")
            equal = own[order][1:] == own[order][:-1]
            if equal.any():
                twice = np.zeros(len(own) + WINDOW, dtype=np.int64)
                hit = np.union1d(order[1:][equal], order[:-1][equal])
                twice[hit] += 1
                np.subtract.at(twice, hit + WINDOW, 1)
                out[i] = (np.cumsum(twice) > 0).sum()
        return out

    def _top_word(self):
        """Occurrences of the most frequent word."""
        first, hashed = self._spans()[2], self._hashes()
        out = np.zeros(len(self), dtype=np.int64)
        for i in np.flatnonzero(np.diff(first)):
            own = np.sort(hashed[first[i]:first[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            out[i] = np.diff(edge).max()
        return out


@dataclass(frozen=True)
class Rule:
    """A named test; rejects(slice) marks the texts that fail it."""
    name: str
    rejects: Callable[[Slice], np.ndarray]


#: The first two are the base rules; limits are whole numbers so that any engine agrees.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
BASE = (
    Rule("few_words", lambda s: s.stat("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda s: 100 * s.stat("n_repeat_words")
         > MAX_REPEAT_PERCENT * s.stat("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda s: 10 * s.stat("n_symbols") > 3 * s.stat("n_words")),
    Rule("exclamation", lambda s: 10 * s.stat("n_bangs") > 3 * s.stat("n_words")),
    Rule("long_words", lambda s: s.stat("word_chars") > 20 * s.stat("n_words")),
    Rule("short_words", lambda s: 2 * s.stat("word_chars") < 3 * s.stat("n_words")),
    Rule("repeated_lines", lambda s: 2 * s.stat("n_dup_lines") > s.stat("n_lines")),
    Rule("one_word", lambda s: 2 * s.stat("top_word") > s.stat("n_words")),
)


def _measure(rules: tuple[Rule, ...]):
    def run(batches):
        spent, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for _, data, offsets in text.slices(batch.column(0)):
                seen += len(offsets) - 1
                for k, rule in enumerate(rules):
                    fresh = Slice(data, offsets)
                    start = time.thread_time()
                    rejected[k] += int(rule.rejects(fresh).sum())
                    spent[k] += time.thread_time() - start
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected),
             pa.array([seen] * len(rules), pa.int64())], names=["rule", "spent", "rejected", "seen"])
    return run


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.01,
            seed: int = 42) -> tuple[Rule, ...]:
    """Rules by falling rejection per cost, measured on a sample; only the order is sampled."""
    rows = (docs.select(F.col("text").cast("string")).sample(fraction, seed)
            .mapInArrow(_measure(rules), "rule int, spent double, rejected long, seen long")
            .groupBy("rule").agg(F.sum("spent"), F.sum("rejected"), F.sum("seen"))
            .collect())  # one row per rule
    gain = {r[0]: r[2] / max(r[1], 1e-9) for r in rows if r[3]}
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -gain.get(k, 0.0)))


def verdicts(part: Slice, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the rule that rejected each text, -1 if none did; a rule sees only what is left."""
    out = np.full(len(part), -1, dtype=np.int64)
    left = np.arange(len(part))
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.rejects(part)
        if bad.any():
            out[left[bad]] = k
            left, part = left[~bad], part.subset(~bad)
    return out


#: Statistics that ``judged`` returns besides the verdict.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the rejecting rule's name (null if kept)."""
    cascade = ordered(docs, rules)

    def run(batches):
        for batch in batches:
            for row, data, offsets in text.slices(batch.column(1)):
                part = Slice(data, offsets)
                found = verdicts(part, cascade)
                stats = [part.stat(s).astype(np.int64) for s in STATS]
                base = np.any([r.rejects(part) for r in BASE], axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), *map(pa.array, stats), pa.array(base),
                     pa.array((found < 0) & ~base),
                     pa.array([cascade[k].name if k >= 0 else None for k in found], pa.string())],
                    names=["doc_id", *STATS, "base_failed", "kept", "rejected_by"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
        + ", base_failed boolean, kept boolean, rejected_by string")


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs that no rule rejects, with the same columns."""
    cascade = ordered(docs, rules)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [verdicts(Slice(data, offsets), cascade) < 0
                    for _, data, offsets in text.slices(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
