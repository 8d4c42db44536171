"""Near-duplicate documents against all pairs, signatures, stars and components."""

import random

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import near, near_dup, sketch, text
from riskweave.llm.components import components
from tests.llm.cases import Sets, edge_rows, empty, frame, sentence


def shingles(value):
    words = (value or "").encode().lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    found = Sets()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                found.join(i, j)
    return found


def variants(rng, base, n, share):
    words = base.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(max(1, int(len(w) * share))):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        out.append(" ".join(w))
    return out


def corpus(rng):
    rows, k = list(edge_rows(rng)), 100
    for _ in range(12):
        base = sentence(rng, rng.randint(8, 120))
        for t in [base, base.upper(), *variants(rng, base, 6, 0.02), *variants(rng, base, 3, 0.06)]:
            rows.append((k, t))
            k += 3
    hot = sentence(rng, 150)
    for t in variants(rng, hot, 150, 0.01) + [hot] * 150:
        rows.append((k, t))
        k += 1
    passage = sentence(rng, 60)  # shared, but too short a part for a link
    for _ in range(60):
        rows.append((k, passage + " " + sentence(rng, 60)))
        k += 1
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark):
    rows = corpus(random.Random(5))
    want = brute(rows)
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want.find(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    for i, t in rows:
        if i is not None:
            assert sizes[i] == len(shingles(t))


def test_keep_first_keeps_columns_and_one_of_each(spark):
    rows = [(3, "one two three four five six"), (4, "One two three four five six"), (5, None)]
    kept = near_dup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]


def test_repeated_doc_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(9)
    a, b = sentence(rng, 60), sentence(rng, 60)
    near_a = variants(rng, a, 1, 0.02)[0]
    rows = [(0, near_a), (1, a), (1, b), (1, b), (2, b + " end"), (3, a)]
    got = {(r.doc_id, r.component_id, r.kept) for r in
           near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 0, False)}
    kept = near_dup.keep_first(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(0, near_a), (1, b), (1, b)])


def test_a_block_returns_no_more_links_than_members(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(4000)])
    base = rng.choice(words, 120)
    texts = []
    for k in range(120):  # a chain of components that all link to one another
        own = base.copy()
        own[rng.integers(0, 120, 3)] = rng.choice(words, 3)
        texts.append(" ".join(own))
    column = pa.array(texts)
    sets = near_dup._shingles(column)
    fine = sketch.signatures(*sets, near_dup.BANDING.fine)
    rows = [(k, i, out) for i in range(120) for k, out in ((i, True), (i, False))]
    batch = pa.RecordBatch.from_arrays([
        pa.array([k for k, *_ in rows], pa.int64()), pa.array([7] * 240, pa.int64()),
        pa.array([k for k, *_ in rows], pa.int64()), pa.array([o for *_, o in rows]),
        pa.array([int(sets[1][k + 1] - sets[1][k]) for k, *_ in rows], pa.int64()),
        pa.array([fine[k].tobytes() for k, *_ in rows], pa.binary()),
        pa.array([texts[k] for k, *_ in rows])],
        names=["id", "block", "component", "outside", "size", "sketch", "text"])
    found = [tuple(r.values()) for out in near._rest(near_dup.BANDING, near_dup._shingles)(
        iter([batch])) for r in out.to_pylist()]
    assert 0 < len(found) < 120
    got, want = Sets(), Sets()
    full = [shingles(t) for t in texts]
    for i in range(120):
        for j in range(i):
            common = len(full[i] & full[j])
            if 100 * common >= 75 * (len(full[i]) + len(full[j]) - common):
                want.join(i, j)
    for i, j in found:
        got.join(i, j)
        common = len(full[i] & full[j])
        assert 100 * common >= 75 * (len(full[i]) + len(full[j]) - common)
    assert [got.find(i) for i in range(120)] == [want.find(i) for i in range(120)]


def test_empty_table(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [3, 12, 60, 2000])
def test_registers_agree_as_often_as_elements_are_shared(size):
    rng = np.random.default_rng(size)
    hits, estimate, n = 0.0, 0.0, 60
    for _ in range(n):
        all_ = rng.integers(0, 1 << 63, 4 * size, dtype=np.uint64)
        a, b = all_[:3 * size], all_[size:]  # Jaccard 0.5
        pair = [sketch.signatures(x, np.array([0, len(x)]), 256) for x in (a, b)]
        hits += (pair[0] == pair[1]).mean()
        estimate += sketch.similarity(*pair, *(np.array([3 * size]),) * 2)[0]
    assert abs(hits / n - 0.5) < 0.05 and abs(estimate / n - 0.5) < 0.05


def test_signature_ignores_repeats_and_order():
    x = np.arange(50, dtype=np.uint64)
    a = sketch.signatures(x, np.array([0, 50]), 64)
    b = sketch.signatures(np.concatenate([x[::-1], x]), np.array([0, 100]), 64)
    assert (a == b).all()


def test_stars_do_not_depend_on_batch_borders():
    rng = random.Random(3)
    rows = sorted((rng.randrange(8), rng.choice([-1, 4]), rng.randrange(12)) for _ in range(200))

    def batches(step):
        for i in range(0, len(rows), step):
            part = list(zip(*rows[i:i + step]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part],
                                             names=["key", "sub", "id"])

    want = set()
    for key, sub in {r[:2] for r in rows}:
        ids = {r[2] for r in rows if r[:2] == (key, sub)}
        if len(ids) > 1:
            want |= {(key, sub, i, min(ids)) for i in ids}
    for step in (1, 2, 7, 1000):
        got = [tuple(r.values()) for b in near._stars(batches(step)) for r in b.to_pylist()]
        assert set(got) == want


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    want = Sets()
    for a, b in edges:
        want.join(a, b)
    df = spark.createDataFrame(edges + edges[:9], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {i: want.find(i) for i in want.parent if i != 5}
    assert components(df.limit(0)).count() == 0


def test_words_and_windows_match_python_split():
    rng = random.Random(2)
    texts = [t for _, t in edge_rows(rng)] + ["", None, "a  b\tc", "é\x0bü"]
    data, offsets = text.flat(pa.array(texts))
    starts, ends, first = text.words(data, offsets)
    for i, t in enumerate(texts):
        got = [data[a:b].tobytes() for a, b in zip(starts[first[i]:first[i + 1]],
                                                   ends[first[i]:first[i + 1]])]
        assert got == (t or "").encode().split()
    hashed = text.span_hashes(data, starts, ends)
    known = {}
    for h, a, b in zip(hashed, starts, ends):
        assert known.setdefault(data[a:b].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


def test_slices_cover_all_rows():
    column = pa.array(["a" * n for n in (5, 0, 3000, 1, 1, 9)] + [None])
    rows = [len(o) - 1 for _, _, o in text.slices(column, 10)]
    assert sum(rows) == 7 and [r for r, _, _ in text.slices(column, 10)] == [
        sum(rows[:i]) for i in range(len(rows))]


def test_buckets_of_equal_members_are_worked_on_once(spark):
    """One of several buckets of the same members, and none whose only pair was tested."""
    from riskweave.llm import near

    keys = spark.createDataFrame([(1, [10, 11, 14]), (2, [10, 11, 14]), (3, [10, 11]), (4, [12, 13]),
                                  (5, [12, 13])], "id long, keys array<long>")
    labels = spark.createDataFrame([], "id long, component long")
    tested = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    rows = near._mixed(keys, labels, tested).collect()
    buckets = {}
    for r in rows:
        buckets.setdefault(r["key"], set()).add(r["id"])
    assert buckets == {10: {1, 2, 3}, 12: {4, 5}}


def test_discard_deletes_only_written_tables(spark):
    import os

    from riskweave.session import discard, materialise

    table = materialise(spark.range(5), "gone")
    place = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(place)
    discard(table)
    assert not os.path.exists(place)


def test_rest_in_slices_finds_the_same_and_leaves_no_tables(spark, monkeypatch):
    """Blocks of the rest go in slices; tables that nothing reads any more are deleted."""
    import os

    from riskweave import session
    from riskweave.llm import line_dedup, near

    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    stems = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(2)]
    lines = [stem[:a] + rng.choice(letters) * 2 + stem[a:] for stem in stems for a in range(2, 58, 2)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    made = []
    monkeypatch.setattr(near, "materialise", lambda df, name: made.append(name) or
                        session.materialise(df, name))
    whole = {tuple(r) for r in line_dedup.removed_lines(docs).collect()}
    once = made.count("more")
    monkeypatch.setattr(near, "SLICE_ROWS", 5)
    monkeypatch.setattr(near, "SLICE_SHARE", 3)
    folder = session.scratch_folder(spark)
    before = set(os.listdir(folder))
    assert {tuple(r) for r in line_dedup.removed_lines(docs).collect()} == whole and whole
    assert once == 1 and made.count("more") > 2
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"lines", "line_classes", "line_texts", "keys", "mixed", "links", "buckets"}
