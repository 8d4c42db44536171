"""Quality rules against plain counting; the order of the cascade never changes a verdict."""

import random
import re

import numpy as np
import pytest

from riskweave.llm import rules, text
from tests.llm.cases import edge_rows, empty, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(value):
    value = value or ""
    words = WORD.findall(value)
    lines = [x for x in value.split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    top = max((words.count(w) for w in set(words)), default=0)
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", value))
    base = n < 20 or 100 * len(covered) > 30 * n
    kept = not (base or 10 * symbols > 3 * n or 10 * value.count("!") > 3 * n or chars > 20 * n
                or 2 * chars < 3 * n or 2 * dup > len(lines) or 2 * top > n)
    return n, chars, symbols, dup, len(covered), base, kept


def corpus(rng):
    rows = [r for r in edge_rows(rng)]
    for k in range(60):
        base = sentence(rng, rng.randint(1, 40))
        parts = [base] * rng.choice([1, 1, 1, 2, 3]) + [sentence(rng, 9), rng.choice(["", "#", "!!"])]
        rows.append((200 + k, rng.choice([" ", "\n"]).join(parts * rng.choice([1, 1, 2]))))
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus(random.Random(3))
    got = rules.judged(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *plain(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed, r.kept) for r in got), key=key) == want
    docs = frame(spark, rows)
    kept = rules.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)
    assert rules.judged(empty(spark)).count() == 0 and rules.accepted(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_order_changes_no_verdict(seed):
    rng = random.Random(seed)
    import pyarrow as pa
    data, offsets = text.flat(pa.array([t for _, t in corpus(rng)]))
    whole = rules.verdicts(rules.Slice(data, offsets), rules.RULES) < 0
    order = rng.sample(rules.RULES, len(rules.RULES))
    assert (rules.verdicts(rules.Slice(data, offsets), tuple(order)) < 0).tolist() == whole.tolist()


def test_cheap_selective_rules_come_first(spark):
    rows = [(k, "two words" if k % 2 else sentence(random.Random(k), 400)) for k in range(400)]
    calls = []
    slow = rules.Rule("slow", lambda s: np.array([sum(range(20_000)) < 0] * len(s)))
    order = rules.ordered(frame(spark, rows), (slow, rules.RULES[0]), fraction=0.5)
    assert [r.name for r in order] == ["few_words", "slow"] and not calls
