"""Manifest, proofs and folded roots against trees built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskweave.llm import merkle
from tests.llm.cases import EXTRA, SCHEMA, edge_rows, empty, sentence


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, lower=False):
    doc, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha(*map(field, (doc, source, lang, n, text)))


def climb(nodes):
    """Levels of digests from the leaves to the one at the top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k:k + 8]) for k in range(0, len(last), 8)])
    return levels


def walk(levels, i, node):
    """(siblings, folded digest) on the way of place i to the top."""
    proof = []
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        left, right = run[:i % 8], run[i % 8 + 1:]
        proof += left + right
        node, i = sha(*left, node, *right), i // 8
    return proof, node


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[name] = own, climb([leaf_of(r) for r in own])
    top = climb([built[name][1][-1][0] for name in names])
    out = []
    for t, name in enumerate(names):
        own, levels = built[name]
        for i, row in enumerate(own):
            forged = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            low, node = walk(levels, i, leaf_of(row, forged))
            high, node = walk(top, t, node)
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], sha(*low, *high), node,
                        node == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, n, *EXTRA) for d, t, lang, s, n in rows], SCHEMA)


KEY = lambda r: (r[0] is None, r[0] or 0, *r[1:])


def corpus(sizes, rng):
    return [(rng.randint(0, 10 ** 6), rng.choice([None, "", sentence(rng, 5).title()]), lang,
             rng.choice([None, "s"]), rng.choice([None, 7])) for lang, n in sizes for _ in range(n)]


@pytest.mark.parametrize("sizes", [
    [("en", 1)], [("en", 8)], [(None, 9), ("en", 1)], [("é", 65), ("z", 64), (None, 3), ("", 1)],
    [("en", 700), *[(f"l{k}", 1 + k % 3) for k in range(20)]]])
def test_rows_equal_trees_built_by_hand(spark, sizes):
    rows = corpus(sizes, random.Random(len(sizes)))
    got = [tuple(r) for r in merkle.checked(frame(spark, rows)).collect()]
    assert sorted(got, key=KEY) == sorted(expected(rows), key=KEY)


def test_edge_rows_ties_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["en", "de", None]), None, 3) for i, t in edge_rows(rng)]
    rows += [(None, "same", "en", "s", 4)] * 900 + [(5, "SAME", "en", "s", 4)] * 40
    got = [tuple(r) for r in merkle.checked(frame(spark, rows)).collect()]
    assert sorted(got, key=KEY) == sorted(expected(rows), key=KEY)
    assert merkle.checked(empty(spark)).count() == 0 and merkle.build(empty(spark)).root is None


def test_only_requested_branches_are_followed(spark):
    rows = corpus([("en", 300), ("de", 40), ("fr", 1)], random.Random(3))
    manifest = merkle.build(frame(spark, rows))
    some = [rows[5][0], rows[310][0], rows[-1][0]]
    wanted = spark.createDataFrame([(i,) for i in some], "doc_id long")
    found = merkle.proofs(manifest, wanted)
    got = found.select("doc_id", "leaf", merkle.folded(F.col("leaf"), F.col("path")).alias("top"),
                       merkle.proof_digest(F.col("path")).alias("proof")).collect()
    want = {(e[0], e[1], e[4]) for e in expected(rows) if e[0] in some}
    assert {(r.doc_id, r.leaf, r.proof) for r in got} == want
    assert {r.top for r in got} == {manifest.root}


def test_one_changed_byte_changes_the_root(spark):
    rows = corpus([("en", 30)], random.Random(5))
    before = merkle.build(frame(spark, rows)).root
    changed = [*rows[:-1], (*rows[-1][:1], "other", *rows[-1][2:])]
    assert merkle.build(frame(spark, rows[::-1])).root == before
    assert merkle.build(frame(spark, changed)).root != before
