"""Registered queries against their SQL and on a whole small table."""

import pytest

import __spark_entry__
from riskweave.llm.queries import QUERIES, SQL
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2": ["page_id", "url", "text", "n_chars"],
    "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept"],
    "op8": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op12": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_every_row(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = QUERIES[name](spark, SF)
    assert got.count() == n
    assert set(COLUMNS.get(name.split("_")[0], [])) <= set(got.columns)


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
