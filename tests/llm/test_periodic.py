"""Runs and collapsed texts against plain comparison of every place and period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from riskweave.llm import periodic
from tests.llm.cases import edge_rows, empty, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_words=24, min_periods=3):
    """Every maximal stretch by comparing words q apart; of several periods the smallest counts."""
    n, found = len(words), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_short_words(letters):
    rng = random.Random(letters)
    for _ in range(400):
        codes = [rng.randint(1, letters) for _ in range(rng.randint(0, 40))]
        for least, periods in [(2, 2), (3, 3), (6, 2), (8, 3)]:
            assert periodic.runs_of(codes, least, periods) == plain_runs(codes, least, periods)


def test_runs_of_repetitive_sequences():
    fib, last = [1, 2], [1]
    while len(fib) < 500:
        fib, last = fib + last, fib
    morse = [1 + bin(i).count("1") % 2 for i in range(512)]
    for codes in (fib[:500], morse, [1] * 300, [1, 2, 3] * 90 + [1, 2] * 40, list(range(1, 300))):
        assert periodic.runs_of(codes, 2, 2) == plain_runs(codes, 2, 2)
        assert periodic.runs_of(codes) == plain_runs(codes)


def pieces(rng):
    """Words with planted runs, near runs and repeated passages."""
    out = []
    for _ in range(rng.randint(1, 5)):
        base = sentence(rng, rng.randint(1, 12)).split()
        kind = rng.randint(0, 4)
        if kind == 0:
            out += base
        elif kind == 1:
            out += (base * 40)[:rng.randint(10, 90)]
        elif kind == 2:
            out += base + sentence(rng, 9).split() + base
        elif kind == 3:
            tile = (base * 30)[:rng.randint(20, 80)]
            tile[len(tile) // 2] = "odd"
            out += tile
        else:
            out += [rng.choice("ab") for _ in range(rng.randint(5, 60))]
    return out


def test_seeds_lose_no_run():
    rng = random.Random(12)
    for _ in range(300):
        words = [w.encode() for w in pieces(rng)]
        known = {w: k for k, w in enumerate(sorted(set(words)))}
        hashes = np.array([known[w] * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)
        assert periodic.text_runs(words, hashes) == plain_runs(words)


def test_long_period_and_long_text():
    rng = random.Random(4)
    base = sentence(rng, 3000).split()
    words = [w.encode() for w in base * 4 + sentence(rng, 500).split() + ["a", "b"] * 4000]
    known = {w: k for k, w in enumerate(sorted(set(words)))}
    hashes = np.array([known[w] * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)
    found = periodic.text_runs(words, hashes)
    assert (0, 12000, 3000) in found and any(q == 2 and n >= 8000 for _, n, q in found)
    for start, length, q in found:
        part = words[start:start + length]
        assert part[q:] == part[:-q] and length >= max(24, 3 * q)


def expected(doc, value):
    words = WORD.findall(value or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(left))


def test_query_columns(spark):
    rng = random.Random(6)
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in edge_rows(rng)]
    rows += [(100 + k, rng.choice([" ", "\n", " \t"]).join(pieces(rng))) for k in range(250)]
    rows += [(k, sentence(rng, rng.randint(0, 120))) for k in range(2000, 2150)]
    got = periodic.digests(periodic.with_runs(frame(spark, rows), periodic.planted)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli,
                    r.runs_sha256, r.collapsed_sha256) for r in got), key=key) == sorted(
        (expected(*r) for r in rows), key=key)
    assert sum(r.n_runs for r in got) > 150
    assert periodic.digests(periodic.with_runs(empty(spark))).count() == 0


def test_operator_returns_runs_and_text(spark):
    rows = [(1, "x " + "a b " * 20 + "c"), (2, "a b c"), (3, None)]
    got = {r.doc_id: r for r in periodic.with_runs(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 40, 2)] and got[1].collapsed == "x a b c"
    assert not got[2].runs and got[2].collapsed == "a b c"
    assert not got[3].runs and got[3].collapsed == "" and got[3].n_words == 0
