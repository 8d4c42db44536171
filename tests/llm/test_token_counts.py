"""Token counts against the tokenizer library, for whole texts and for prefixes."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskweave.llm.token_counts import PrefixCounter, prefix_tables, token_counts
from tests.llm.cases import edge_rows, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def random_text(rng):
    parts = ["the", "tion", " ", "  ", "\n", "\t", "'s", "'", "don't", "12", "345", "é", "日本", "🙂",
             "<|endoftext|>", "<|", "#$%", "Hello", " ", "　", "_", "...", "aaaaaaa"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_counts_match_library(counter, library):
    rng = random.Random(1)
    for _ in range(1500):
        value = random_text(rng)
        assert counter.count(value) == library(value), repr(value)


def test_every_prefix_matches_library(counter, library):
    rng = random.Random(2)
    for _ in range(60):
        value = random_text(rng)
        table = counter.table(value)
        for end in range(len(value) + 1):
            assert counter.prefix_count(value, table, end) == library(value[:end]), repr(value[:end])


def test_dynamic_programme_matches_merging(counter):
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"ththeionrest anding,.") for _ in range(rng.randint(1, 18)))
        assert counter.prefixes(data) == [0] + [len(counter.merged(data[:i]))
                                                for i in range(1, len(data) + 1)]


def test_longest_prefix_fits_and_is_longest(counter):
    value = "The thinges of the nation, and 12345 others' words. " * 9
    table = counter.table(value)
    for budget in (0, 1, 5, 40, 10_000):
        end = counter.longest_prefix(value, table, budget)
        assert end == counter.fit(value, budget)
        k = list(table[0]).index(end)
        assert table[1][k] <= budget and (k + 1 == len(table[0]) or table[1][k + 1] > budget)


def test_cut_pieces_do_not_change_counts(counter, library, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr("riskweave.llm.token_counts.PIECE", 7)
    for _ in range(300):
        value = random_text(rng)
        assert counter.count(value) == library(value)


def test_rows(spark, library):
    rows = edge_rows(random.Random(5))
    got = token_counts(frame(spark, rows), PATH, limit=50).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (len((t or "").encode()), library(t or ""), library(t or "") > 50) for _, t in rows)
    tables = prefix_tables(frame(spark, rows[4:6]), PATH).collect()
    assert all(r.counts[-1] == library(rows[4][1]) for r in tables)
    assert token_counts(empty(spark), PATH).count() == 0


def brute_fit(library, value, budget):
    return max(end for end in range(len(value) + 1) if library(value[:end]) <= budget)


def test_fit_is_exact_in_one_long_run(counter, library):
    rng = random.Random(6)
    runs = ["".join(rng.choice("0123456789abcdef") for _ in range(150)),
            "".join(rng.choice("ABCDxyz") for _ in range(150)), " " * 150, "\n" * 75 + "x", "=" * 150,
            "#-" * 75, "日本語の文章" * 25, "ไม่มีช่องว่าง" * 10, "7" * 150]
    for run in runs:
        for value in (run, "two words " + run + " and more"):
            table = counter.table(value)
            for budget in (0, 1, 2, 7, 20, 60, 500):
                want = brute_fit(library, value, budget)
                assert counter.fit(value, budget) == want, (value, budget)
                assert counter.longest_prefix(value, table, budget) == want, (value, budget)


def test_fit_is_exact_in_mixed_texts(counter, library):
    rng = random.Random(7)
    for _ in range(150):
        value = random_text(rng)
        table, total = counter.table(value), library(value)
        for budget in {0, 1, total // 3, total // 2, max(total - 1, 0), total}:
            want = brute_fit(library, value, budget)
            assert counter.fit(value, budget) == want, (value, budget)
            assert counter.longest_prefix(value, table, budget) == want, (value, budget)


def test_long_run_at_the_start_has_a_prefix(spark, library):
    value = "".join(random.Random(8).choice("0123456789abcdef") for _ in range(400))
    (row,) = token_counts(frame(spark, [(1, value)]), PATH, limit=50).collect()
    assert row.fit_chars == brute_fit(library, value, 50) > 0
