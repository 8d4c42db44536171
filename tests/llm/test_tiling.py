"""Greedy string tiling against a direct version, and leaks in documents."""

import random

import numpy as np
import pytest

from riskweave.llm import tiling
from tests.llm.cases import edge_rows, empty, frame, sentence


def brute(item, doc, least):
    """Longest unmarked match first, ties by place in the item, then in the document."""
    mark_a, mark_b, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] \
                        and not mark_a[i + n] and not mark_b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        mark_a[i:i + n] = mark_b[j:j + n] = [True] * n
        out.append((i, j, n))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_match_direct_version(seed):
    rng = random.Random(seed)
    item = [rng.randrange(4 + seed % 5) for _ in range(rng.randint(0, 30))]
    doc = [rng.randrange(4 + seed % 5) for _ in range(rng.randint(0, 40))]
    for _ in range(2):
        if len(item) > 8:
            i, j = rng.randrange(len(item) - 6), rng.randrange(len(doc) + 1)
            doc[j:j] = item[i:i + rng.randint(4, 12)]
    k = tiling.SEED
    hits = [(i, j) for i in range(len(item) - k + 1) for j in range(len(doc) - k + 1)
            if item[i:i + k] == doc[j:j + k]]
    got = tiling.tiles(np.array(item, np.int64), np.array(doc, np.int64),
                       np.array(hits, np.int64).reshape(-1, 2))
    assert sorted(got) == sorted(brute(item, doc, k))


def test_hash_collisions_are_checked_on_the_words():
    item, doc = np.arange(10), np.arange(10) + 100
    assert tiling.tiles(item, doc, np.array([[0, 0], [1, 1], [2, 2]])) == []


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, ". ".join(sentence(rng, 9) for _ in range(4))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "a b"), (None, sentence(rng, 20)), (3, items[3][1])]
    own = [sentence(rng, 50) for _ in range(8)]
    parts = items[5][1].split(". ")
    rows = [(1, own[0]), (2, f"{own[1]} {items[1][1].upper()} {own[2]}"),
            (3, f"{own[3]} " + f" {own[4]} ".join(reversed(parts))),          # reordered
            (4, f"{own[5]} {' '.join(items[7][1].split()[:13])} {own[6]}"),   # a third of an item
            (5, items[8][1] + "\n" + items[3][1]), (6, items[-2][1])]
    edge = [(i and i + 1000, t) for i, t in edge_rows(rng)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in tiling.contamination(frame(spark, rows + edge), bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {2, 3, 5, 6}
    assert got[2].item_ids == [1] and got[2].coverage == 1.0
    assert got[3].item_id == 5 and got[3].n_tiles == 4
    assert got[5].item_ids == [3, 3, 8] and got[5].item_id == 3
    assert got[6].item_ids == [None] and got[1].item_id is None and got[1].item_ids == []
    docs = frame(spark, rows + edge)
    clean = tiling.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows + edge) - 4
    assert tiling.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert tiling.contamination(empty(spark), bench).count() == 0


def test_blocks_give_the_same_result(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, sentence(rng, 15)) for k in range(12)]
    docs = frame(spark, [(k, sentence(rng, 10) + " " + items[k % 12][1] + " " + items[-1 - k % 12][1])
                         for k in range(20)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    def found():
        return sorted((r.doc_id, sorted(r.item_ids)) for r in
                      tiling.contamination(docs, bench).collect())
    whole = found()
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 400)
    assert len(tiling._blocks(bench)) > 2 and found() == whole
