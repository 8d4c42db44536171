"""Sampled segmentations: exact round trips, reproducibility and the lattice's distribution."""

import math
import random
from collections import Counter

import public_tokenizers
import sentencepiece

from riskweave.llm import pieces
from tests.llm.cases import edge_rows, empty, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def paths(lattice, unit):
    """All segmentations of a unit with their weights."""
    if not unit:
        return {(): 1.0}
    out = {}
    for n in range(1, len(unit) + 1):
        head = unit[:n]
        if head in lattice.weight:
            step = ((lattice.ids[head],), lattice.weight[head])
        elif n == 1:
            spelled = tuple(lattice.byte_ids[b] for b in head.encode())
            step = (spelled, pieces.SPELLED ** len(spelled))
        else:
            continue
        for rest, w in paths(lattice, unit[n:]).items():
            key = step[0] + rest
            out[key] = out.get(key, 0.0) + step[1] * w
    return out


def test_samples_follow_the_path_weights():
    lattice = pieces.Lattice(MODEL)
    want = paths(lattice, " thes")
    total, n = sum(want.values()), 20_000
    got = Counter(tuple(lattice.sample("thes", k)) for k in range(n))
    assert set(got) <= set(want) and len(want) > 5
    for path, w in want.items():
        share = w / total
        assert abs(got[path] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-9


def test_texts_sampled_together_are_the_texts_sampled_alone():
    """Paths depend on the row key and the text, not on what else is known or in the batch."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("the aé日\n ,") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    together = pieces.Lattice(MODEL).sample_many(texts, list(range(50)))
    alone = pieces.Lattice(MODEL)
    for k in reversed(range(50)):
        assert alone.sample(texts[k], k).tolist() == together[k].tolist()


def test_edges_of_a_unit_carry_the_path_weights():
    lattice = pieces.Lattice(MODEL)
    units = [" thes", "日é", " a", "z" * 300]
    first, begin, sums, starts, _ = lattice._forward(units)
    for k, unit in enumerate(units[:3]):
        last = sums[begin[first[k + 1]] - 1]
        assert math.isclose(last, sum(paths(lattice, unit).values()), rel_tol=1e-12)
    assert (sums > 0).all() and (starts[begin[first[:-1]]] == 0).all()


def test_round_trip_of_many_texts():
    rng = random.Random(9)
    lattice = pieces.Lattice(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    alphabet = "ab e\n\t ▁éß日🙂\x00 <s>"
    for k in range(400):
        value = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = lattice.sample(value, k)
        assert lattice.decode(ids) == value
        if "▁" not in value and "\x00" not in value:
            assert library.decode(list(ids)) == value
    mixed = "".join(rng.choice("aé日e") for _ in range(9000))
    assert lattice.decode(lattice.sample(mixed, 5)) == mixed
    long = "z" * (3 * pieces.LONGEST + 5)
    assert lattice.decode(lattice.sample(long, 1)) == long


def test_rows(spark):
    rows = edge_rows(random.Random(2))
    docs = frame(spark, rows)
    got = pieces.segmentations(docs, MODEL)
    found = got.collect()
    assert len(found) == len(rows) and all(r.lossless for r in found)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[6][0].pieces == by_id[6][1].pieces       # same key, same text
    assert by_id[5][0].pieces != by_id[6][0].pieces       # same text, another key
    assert by_id[1][0].n_pieces == by_id[2][0].n_pieces == 0
    again = {r.doc_id: r.pieces for r in pieces.segmentations(docs.repartition(5), MODEL).collect()}
    assert all(again[r.doc_id] == r.pieces for r in found if r.doc_id is not None)
    texts = sorted(r.text for r in pieces.decoded(got, MODEL).collect())
    assert texts == sorted(t or "" for _, t in rows)
    assert pieces.segmentations(empty(spark), MODEL).count() == 0
