"""The pipeline stage by stage against plain versions of the operators."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from riskweave.llm import pieces
from tests.llm import test_line_dedup, test_near_dup, test_rules
from tests.llm.cases import edge_rows, empty, frame, sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    items = [(k, sentence(rng, 30)) for k in range(8)]
    lines = [sentence(rng, 14) for _ in range(30)]
    rows = [r for r in edge_rows(rng) if r[0] != 4]
    for k in range(150):
        own = [sentence(rng, 16) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            own.append(rng.choice(lines))
        if rng.random() < 0.1:
            own.insert(0, sentence(rng, 5) + " " + rng.choice(items)[1] + " " + sentence(rng, 5))
        if rng.random() < 0.1:
            own = ["# " * 40]
        rows.append((100 + k, "\n".join(own)))
    rows += [(900 + k, rows[30 + k][1] + " indeed") for k in range(20)]
    path = tmp_path_factory.mktemp("sf")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def direct(rows, items):
    rows = [(i, t) for i, t in rows if test_rules.plain(t)[-1]]
    stay = test_line_dedup.brute(rows)
    form, out = test_line_dedup.form, []
    for i, t in rows:
        lines = t.split("\n")
        keep = [x for n, x in enumerate(lines) if i is None or not form(x) or (i, n) in stay]
        if any(form(x) for x in keep):
            out.append((i, "\n".join(keep)))
    found = test_near_dup.brute(out)
    out = [(i, t) for i, t in out if i is None or found.find(i) == i]

    def leaks(t):
        words = t.lower().split()
        runs = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
        for _, item in items:
            w = item.lower().split()
            hit = {k + j for k in range(len(w) - 4) if tuple(w[k:k + 5]) in runs for j in range(5)}
            if len(hit) >= 0.5 * len(w):  # items are planted whole, so tiles cover all shared runs
                return True
        return False
    return [(i, t) for i, t in out if not leaks(t)]


def test_run_matches_direct_version(spark, folder):
    path, rows, items = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = direct(rows, items)
    assert 0 < len(want) < len(rows)
    lattice = pieces.Lattice(MODEL)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.pieces)) for r in got), key=key) == sorted(
        ((i, list(lattice.sample(t, i))) for i, t in want), key=key)


def test_stages_keep_columns_and_stand_empty_tables(spark, folder):
    path, rows, _ = folder
    docs, none = frame(spark, rows), empty(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, path).count() == 0
        assert stage(spark, docs, path).dtypes == docs.dtypes, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, path).count() == 0
