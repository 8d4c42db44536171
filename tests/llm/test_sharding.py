"""Contiguous partition against dynamic programming, and the law of equal sizes."""

import random
import zlib
from functools import cache

import pytest

from riskweave.llm import sharding
from tests.llm.cases import edge_rows, empty, frame, sentence


def best(sizes, shards):
    """Smallest possible largest run, by trying all cuts."""
    @cache
    def go(start, left):
        if left == 1:
            return sum(sizes[start:])
        return min((max(sum(sizes[start:k]), go(k, left - 1)) for k in range(start, len(sizes) + 1)),
                   default=0)
    return go(0, shards)


@pytest.mark.parametrize("seed", range(30))
def test_smallest_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 99)]) for _ in range(rng.randint(1, 14))]
    shards = rng.randint(1, 6)
    capacity = sharding.smallest_capacity(sizes, shards)
    assert capacity == best(tuple(sizes), shards)
    runs = sharding.cut(sizes, capacity)
    assert len(runs) <= shards and sum(runs) == len(sizes)


def test_hot_bucket_gets_a_shard_and_the_rest_is_even():
    sizes = {b: 10 for b in range(5000)} | {7: 30_000}
    shard = sharding.plan(sizes, 8)
    load = [sum(sizes[b] for b in sizes if shard[b] == s) for s in range(8)]
    assert set(shard) == set(sizes) and load[0] == 30_000
    assert max(load[1:]) - min(load[1:]) <= 80
    sizes[7] = 7_000  # less than an equal share: all are even
    shard = sharding.plan(sizes, 8)
    load = [sum(sizes[b] for b in sizes if shard[b] == s) for s in range(8)]
    assert max(load) - min(load) <= 80


def test_rows(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(sharding, "CELL_ROWS", 20)
    rows = edge_rows(rng)
    rows = [r for r in rows if r[0] != 4] + [(100 + k, sentence(rng, 20)) for k in range(1500)]
    rows += [(5000 + k, rows[4][1]) for k in range(300)]
    got = sharding.assign(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    raw = lambda t: (t or "").encode()
    assert sorted((r.doc_id or -99, r.size, r.text_crc32) for r in got) == sorted(
        (i or -99, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(
            range(sum(r.shard == s for r in got)))
    crc = {}
    for r in got:
        assert crc.setdefault((r.text_crc32, r.size), r.shard) == r.shard  # copies stay together
    load = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    hot = {r.shard for r in got if r.doc_id == 5000}
    rest = [x for s, x in enumerate(load) if s not in hot]
    assert len(hot) == 1 and max(rest) < 1.05 * sum(rest) / 7 + max(r.size for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = {(r.doc_id, r.text_crc32): r.shard for r in
             sharding.assign(frame(spark, rows).repartition(3)).collect()}
    assert all(again[r.doc_id, r.text_crc32] == r.shard for r in got)
    assert sharding.assign(empty(spark)).count() == 0


def test_write_shards(spark, tmp_path):
    docs = frame(spark, [(k, f"text {k}") for k in range(200)])
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard_").distinct().count() == 4
