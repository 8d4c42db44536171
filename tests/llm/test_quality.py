"""Quadratic discriminant against a direct computation, and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa

from riskweave.llm import quality, text
from tests.llm.cases import edge_rows, empty, frame

SF = "/root/testdata/sf0.01"


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, SF)
    got = quality.quality_scores(docs, labels)
    held = got.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(held) > 50
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where("predicted <> int(score >= 0.3)").count() == 0


def test_scores_match_direct_densities(spark):
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    rows = {r.doc_id: r.text for r in docs.collect()}
    x = {i: quality.features(*text.flat(pa.array([t])))[0] for i, t in rows.items()}
    learn = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None
             and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5]
    groups = [np.array([v for v, q in learn if q == k]) for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    n = np.array([len(g) for g in groups])
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    density = []
    for g, c in zip(groups, own):
        c = (0.9 * c + 0.1 * pooled) / np.outer(unit, unit)
        c = 0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c))
        inverse, log_det = np.linalg.inv(c), np.linalg.slogdet(c)[1]
        z = (np.array(list(x.values())) - g.mean(axis=0)) / unit
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, inverse, z) + log_det))
    odds = np.clip((density[1] - density[0]) / quality.TEMPERATURE, -500, 500) + np.log(n[1] / n[0])
    want = dict(zip(x, 1 / (1 + np.exp(-odds))))
    for r in quality.quality_scores(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_edge_rows(spark):
    rows = edge_rows(random.Random(1))
    docs, labels = tables(spark, "/root/testdata/sf0.001")
    got = quality.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    none = quality.quality_scores(frame(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(frame(spark, rows), one).collect()} == {1.0}
    assert quality.quality_scores(empty(spark), labels).count() == 0
