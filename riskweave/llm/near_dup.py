"""Near-duplicate documents by banded HyperMinHash signatures and exact word-shingle sets.

Texts are folded (A-Z) and split at ASCII white space. A document's set is its distinct five-word
shingles; with fewer words the whole sequence is the only one. Two documents are linked when
100 x |intersection| >= percent x |union|; a document belongs to the component of the smallest
doc_id reachable over links.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with
nothing. Rows that repeat a doc_id are each judged by their own text: classes of equal texts have
numbers of their own, and only the result names them by their smallest doc_id. A row without doc_id
has no component (null) and stays. An empty table gives an empty result. Only doc_id and text are
read, so further columns and their names do not matter.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from riskweave.llm import near, sketch, text
from riskweave.operators.ranks import spread_join
from riskweave.session import materialise

SIZE = 5
#: 40 bands of 4 registers miss a pair at the threshold 0.75 with probability 3e-7; the estimate
#: from 512 registers has a standard deviation of 0.019 there, and its floor is 4.2 of them below.
BANDING = near.Banding(buckets=512, bands=40, rows=4, percent=75, floor=0.67, fine=512)


def _profiles(batches):
    """(doc_id, tie, digest, size, sketch); the digest is that of the folded word sequence."""
    for batch in batches:
        ids, column, tie = batch.column(0), batch.column(1), batch.column(2)
        for row, data, offsets in text.slices(column):
            shingles = text.word_shingles(data, offsets, SIZE)
            signature = sketch.signatures(*shingles, BANDING.buckets)
            size = np.diff(shingles[1])
            raw = text.LOWER[data].tobytes()
            digest = [blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() if n else None
                      for a, b, n in zip(offsets[:-1], offsets[1:], size)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(size)), tie.slice(row, len(size)), pa.array(digest, pa.binary()),
                 pa.array(size.astype(np.int64)),
                 pa.array([s.tobytes() for s in signature], pa.binary())],
                names=["doc_id", "tie", "digest", "size", "sketch"])


def _bands(batches):
    for x in batches:
        if x.num_rows:
            signature = near._matrix(x.column("sketch"), BANDING.buckets)
            yield near.band_batch(x.column("id").to_numpy(), signature, BANDING)


def similar(a: pa.Array, b: pa.Array, percent: int = BANDING.percent) -> np.ndarray:
    """Row by row: do the full shingle sets of both texts reach the similarity?"""
    out = np.zeros(len(a), dtype=bool)
    step = 256
    for i in range(0, len(a), step):
        sets = [text.word_shingles(*text.flat(x.slice(i, step)), SIZE) for x in (a, b)]
        common, union = text.intersections(*sets)
        out[i:i + step] = 100 * common >= percent * union
    return out


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [text.word_shingles(data, offsets, SIZE) for _, data, offsets in text.slices(texts)]
    sizes = np.concatenate([np.diff(p[1]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_shingles, component_id, kept) of every row; tie is a hash of its text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("tie"))
    base = materialise(docs.mapInArrow(
        _profiles, "doc_id long, tie long, digest binary, size long, sketch binary"), "profiles")
    # exact copies (of the folded words) are one class, pre-aggregated before the shuffle; a class
    # has a number of its own, because a doc_id can stand for different texts
    first = F.min(F.struct("doc_id", "tie"))
    classes = materialise(
        base.where("digest is not null and doc_id is not null").groupBy("digest")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
             F.first("sketch").alias("sketch"))
        .select("digest", "first.doc_id", "first.tie", "copies", "size", "sketch",
                F.monotonically_increasing_id().alias("id")), "classes")
    facts = classes.select("id", "size", "sketch")

    def texts(ids: DataFrame) -> DataFrame:
        """One text of every class: rows of the class's first doc_id with the first's hash."""
        wanted = near.only_ids(classes.select("id", "doc_id", "tie"), ids)
        few = ids.count() <= near.BROADCAST_IDS
        found = docs.join(broadcast(wanted) if few else wanted, ["doc_id", "tie"])
        return found.groupBy("id").agg(F.first("text").alias("text"))

    found = near.link(
        facts.mapInArrow(_bands, near.BANDS_SCHEMA),
        lambda _: (lambda ids: near.only_ids(facts, ids), texts), similar, _shingles, BANDING)
    joined = materialise(classes.join(found, "id", "left").select(
        "digest", "doc_id", "copies", F.coalesce("component", "id").alias("component")), "components")
    least = materialise(joined.groupBy("component").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    named = materialise(spread_join(joined, least, ["component"], "n").select(
        "digest", "copies", "least"), "named")
    whole = base.where("digest is not null and doc_id is not null")
    linked = spread_join(whole.select("doc_id", "tie", "size", "digest"), named, ["digest"], "copies")
    rows = linked.select("doc_id", "tie", "size", "least").unionByName(
        base.where("digest is null or doc_id is null").select(
            "doc_id", "tie", "size", F.col("doc_id").alias("least")))
    return rows.select("doc_id", "tie", F.col("size").alias("n_shingles"),
                       F.col("least").alias("component_id"),
                       F.coalesce(F.col("doc_id") == F.col("least"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; see the module's text."""
    return _judged(docs).drop("tie")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; columns unchanged."""
    drop = _judged(docs).where("not kept").select(
        F.col("doc_id").alias("doc_id_"), F.col("tie").alias("tie_")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("doc_id_")) & (
        F.xxhash64(F.col("text").cast("string")) == F.col("tie_"))
    return docs.join(drop, same, "left_anti")
