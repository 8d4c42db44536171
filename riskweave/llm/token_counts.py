"""Exact byte-level BPE token counts of every prefix, by dynamic programming over prefixes.

A text is cut at special strings and then into pretokens by the tokenizer's pattern; merges never
cross a pretoken. Within one, the encoding of a prefix ends in exactly one token that may follow the
encoding before it: the suffix token whose pair with the last token of the shorter prefix stays
unmerged when both are encoded together. So last[i] and count[i] = count[i - len(token)] + 1 follow
for every prefix, each pretoken is worked out once per worker, and running sums over pretokens answer
how many tokens a prefix has. The longest prefix within a budget is exact at every code point: the
counts inside the pretoken where the budget ends are worked out again.

The count of a prefix is that of encoding the prefix as a text of its own: its last pretokens can
differ from those of the whole text (white space before a word, letters after an apostrophe, the
start of a special string), so the tail is cut again.

Defined cases: a null text counts as empty and has no tokens. Rows with null or repeated doc_id are
counted by their own text. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the byte-level pretokenizer (fixed value of the tokenizer format).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of a text cut into pretokens at once; cuts lie between a word and white space.
PIECE = 1 << 18
#: Pretokens whose counts, and token pairs whose verdicts, a worker keeps.
CACHE = 500_000
#: Pretokens whose prefixes are cut into other pretokens.
_SHORT_FORMS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Stands for the token before the first one.
NONE = (1 << 20) - 1


def _byte_letters() -> dict[str, int]:
    """The letter that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixCounter:
    """Token counts of texts and of all their prefixes for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] \
                or spec["normalizer"] is not None:
            raise ValueError("expected a byte-level BPE vocabulary without normalizer")
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        added = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        # what a token can start with; -1 where that is no token itself
        self.heads = {t[:k]: -1 for t in self.vocab for k in range(1, len(t))} | self.vocab
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len)[::-1])))
        self.pattern = regex.compile(PATTERN)
        self.raw = {i: t for t, i in self.vocab.items()}
        self._pairs: dict[int, bool] = {}
        self._whole: dict[str, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of a short byte string by merging the lowest-ranked pair again and again."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i)
                           for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: int, token: int) -> bool:
        """Do two tokens (or, after NONE, one) stay as they are when encoded together?"""
        raw = self.raw
        whole = self.merged(raw[before] + raw[token] if before != NONE else raw[token])
        known = whole == ([raw[before], raw[token]] if before != NONE else [raw[token]])
        if len(self._pairs) >= CACHE:
            self._pairs.clear()
        self._pairs[before << 20 | token] = known
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """Number of tokens of data[:i] for every i from 0 to len(data)."""
        n, heads, pairs = len(data), self.heads.get, self._pairs.get
        into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j in range(n):
            for i in range(j + 1, n + 1):
                token = heads(data[j:i])
                if token is None:
                    break
                if token >= 0:
                    into[i].append((j, token))
        last, count = [NONE], [0]
        for i in range(1, n + 1):
            for j, token in into[i]:
                before = last[j]
                known = pairs(before << 20 | token)
                if known is None:
                    known = self._may_follow(before, token)
                if known and j:
                    known = pairs(NONE << 20 | token)
                    if known is None:
                        known = self._may_follow(NONE, token)
                if known:
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def _tokens(self, pretoken: str) -> int:
        known = self._whole.get(pretoken)
        if known is None:
            known = self.prefixes(pretoken.encode())[-1]
            if len(self._whole) >= CACHE:
                self._whole.clear()
            self._whole[pretoken] = known
        return known

    def pretokens(self, value: str):
        """Lists of pretokens of a text without special strings, about PIECE characters each."""
        at = 0
        while at < len(value):
            end = at + PIECE
            while end < len(value) and not (value[end].isspace() and not value[end - 1].isspace()):
                end += 1
            yield self.pattern.findall(value, at, end) if end < len(value) \
                else self.pattern.findall(value, at)
            at = end

    def _plain_parts(self, value: str):
        """(text between special strings, special string or '') in order."""
        at = 0
        for found in self.special.finditer(value):
            yield value[at:found.start()], found.group()
            at = found.end()
        yield value[at:], ""

    def count(self, value: str) -> int:
        """Tokens of a whole text."""
        total, known, slow = 0, self._whole.get, self._tokens
        for plain, special in self._plain_parts(value):
            for found in self.pretokens(plain):
                for p in found:
                    n = known(p)
                    total += slow(p) if n is None else n
            total += bool(special)
        return total

    def table(self, value: str) -> tuple[array, array]:
        """(ends, counts): end in characters and token count after every pretoken or special."""
        ends, counts, at, total = array("q", [0]), array("q", [0]), 0, 0
        for plain, special in self._plain_parts(value):
            for found in self.pretokens(plain):
                for p in found:
                    at, total = at + len(p), total + self._tokens(p)
                    ends.append(at)
                    counts.append(total)
            if special:
                at, total = at + len(special), total + 1
                ends.append(at)
                counts.append(total)
        return ends, counts

    def prefix_count(self, value: str, table: tuple[array, array], end: int) -> int:
        """Tokens of value[:end] as a text of its own, from the stored table and a short tail."""
        ends, counts = table
        k = self._anchor(value, ends, bisect_right(ends, end) - 1, end)
        return counts[k] + self.count(value[ends[k]:end])

    @staticmethod
    def _anchor(value: str, ends, k: int, end: int) -> int:
        """The last boundary up to k and before end that no continuation can move: word | white space
        or the start."""
        while k and not (ends[k] < end and value[ends[k]].isspace()
                         and not value[ends[k] - 1].isspace()):
            k -= 1
        return k

    def _inside(self, value: str, start: int, end: int, before: int, anchor: tuple[int, int],
                budget: int) -> int | None:
        """The longest prefix within the budget that ends in the pretoken or special value[start:end].

        Cut behind its first character, a pretoken may leave that one to the white space before it;
        cut later, it stays one pretoken, unless it is a special or a short form.
        """
        part = value[start:end]
        if part in _SHORT_FORMS or self.special.fullmatch(part):
            whole = range(end, start, -1)
        else:
            whole = (start + 1,)
            if len(part) > 1 and before < budget:
                data = part.encode()
                row, i = self.prefixes(data), len(data)
                for at in range(end, start + 1, -1):
                    if before + row[i] <= budget:
                        return at
                    i -= len(value[at - 1].encode())
        at, known = anchor
        return next((i for i in whole if known + self.count(value[at:i]) <= budget), None)

    def _longest(self, value: str, parts, budget: int) -> int:
        """The longest prefix within the budget, from (start, end, tokens before and after, anchor)
        of the pretokens and specials in order."""
        best, over, last = 0, [], 0
        for part in parts:
            _, end, before, after, _ = part
            if after <= budget:
                best, over = end, []
            else:
                over.append(part)
                if last >= budget:  # a cut can move the pretoken before, but no earlier one
                    break
            last = before
        for start, end, before, _, anchor in reversed(over):
            found = self._inside(value, start, end, before, anchor, budget)
            if found is not None:
                return found
        return best

    def longest_prefix(self, value: str, table: tuple[array, array], budget: int) -> int:
        """Code points of the longest prefix with at most `budget` tokens, from the stored table."""
        ends, counts = table

        def parts():
            # parts before the last one that fits need not be looked at
            for k in range(max(bisect_right(counts, budget) - 1, 1), len(ends)):
                a = self._anchor(value, ends, k - 1, ends[k])
                yield ends[k - 1], ends[k], counts[k - 1], counts[k], (ends[a], counts[a])
        return self._longest(value, parts(), budget)

    def fit(self, value: str, budget: int) -> int:
        """The same without a stored table; reads only as far as the budget lasts."""
        def parts():
            at = total = 0
            anchor = (0, 0)
            for plain, special in self._plain_parts(value):
                for p, n in self._pieces(plain, special):
                    if at and value[at].isspace() and not value[at - 1].isspace():
                        anchor = (at, total)
                    yield at, at + len(p), total, total + n, anchor
                    at, total = at + len(p), total + n
        return self._longest(value, parts(), budget)

    def _pieces(self, plain: str, special: str):
        """(pretoken, tokens) of a text one by one, then the special string behind it."""
        for found in self.pattern.finditer(plain):
            yield found.group(), self._tokens(found.group())
        if special:
            yield special, 1


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ends, counts): the stored prefix counts of every text, see ``PrefixCounter.table``."""
    def run(batches):
        known = counter(path)
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends, counts = known.table(value or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([ends], pa.list_(pa.int64())),
                     pa.array([counts], pa.list_(pa.int64()))], names=["doc_id", "ends", "counts"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ends array<long>, counts array<long>")


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the number of code
    points of the longest prefix that has at most `limit` tokens."""
    def run(batches):
        known = counter(path)
        for batch in batches:
            size, tokens, fit = [], [], []
            for value in batch.column(1):  # one text at a time as a Python string
                value = value.as_py() or ""
                total = known.count(value)
                size.append(len(value.encode()))
                tokens.append(total)
                fit.append(len(value) if total <= limit else known.fit(value, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([t > limit for t in tokens], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")

