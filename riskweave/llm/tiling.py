"""Benchmark decontamination by greedy string tiling.

Texts are folded (A-Z) and split into words at ASCII white space. A document and a benchmark item are
compared when they share a seed, a run of SEED words, found by joining the hashes of the document's
runs with those of the items. The tiling of a pair then repeatedly takes the longest match of words
that no earlier tile covers, as long as it has SEED words: equal runs are found by a rolling
(Karp-Rabin) hash, joined along their diagonals to maximal matches and checked word by word. Tiles
may lie in any order, so a passage whose parts were rearranged is still found. An item is contained
when tiles cover at least the threshold share of its words; a document that contains one is
contaminated.

The benchmark is passed to the tasks in blocks of bounded size (BLOCK_BYTES of text and one item at
least); documents are read once per block and never shuffled.

Defined cases: items with fewer than SEED words (also null or empty ones) cannot be told from chance
and are not searched for. A null or empty document contains nothing. Rows with null or repeated
doc_id are judged by their own text; repeated items count once each, and the best item of ties is
that of the smallest item_id (items without an id come last). An empty benchmark leaves every
document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm import text

SEED = 5
COVERAGE = 0.5
BLOCK_BYTES = 4 << 20


@dataclass
class Items:
    """Words of a block of benchmark items and the sorted hashes of their seeds."""
    ids: list
    words: np.ndarray   # word hashes of all items
    first: np.ndarray   # offsets of items into words
    seeds: np.ndarray   # sorted distinct seed hashes
    begin: np.ndarray   # offsets of seeds into (item, place)
    item: np.ndarray
    place: np.ndarray


def prepare(ids: list, texts: list) -> Items:
    """Items in the order of their ids, with a lookup from seed hash to places."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or ""))
    column = pa.array([texts[k] for k in order], pa.string())
    data, offsets = text.flat(column)
    data = text.LOWER[data]
    starts, ends, first = text.words(data, offsets)
    hashed = text.span_hashes(data, starts, ends)
    seeds, at = text.windows(hashed, first, SEED)
    by_hash = np.argsort(seeds, kind="stable")
    distinct, begin = np.unique(seeds[by_hash], return_index=True)
    at = at[by_hash]
    item = np.searchsorted(first, at, side="right") - 1
    return Items([ids[k] for k in order], hashed, first, distinct,
                 np.append(begin, len(at)), item, at - first[item])


def tiles(item: np.ndarray, doc: np.ndarray, hits: np.ndarray, seed: int = SEED
          ) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of the greedy tiling of two word sequences.

    hits: rows (place in item, place in doc) where runs of `seed` words have equal hashes. Longer
    matches go first, ties by place in the item and then in the document.
    """
    if not len(hits):
        return []
    diagonal = hits[:, 1] - hits[:, 0]
    order = np.lexsort((hits[:, 0], diagonal))
    place, diagonal = hits[order, 0], diagonal[order]
    edge = np.flatnonzero(np.concatenate(
        [[True], (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1), [True]]))
    heap = []
    for a, b in zip(edge[:-1], edge[1:]):
        i, n = int(place[a]), int(b - a) + seed - 1
        j = i + int(diagonal[a])
        # equal hashes are checked on the words; a run may fall apart
        wrong = np.flatnonzero(np.concatenate(
            [[True], item[i:i + n] != doc[j:j + n], [True]]))
        for c, d in zip(wrong[:-1], wrong[1:]):
            if d - c - 1 >= seed:
                heap.append((-int(d - c - 1), i + int(c), j + int(c)))
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        covered = in_item[i:i + n] | in_doc[j:j + n]
        if not covered.any():
            in_item[i:i + n] = in_doc[j:j + n] = True
            out.append((i, j, n))
            continue
        # what is left of the match between words that are covered by now
        edge = np.flatnonzero(np.concatenate([[True], covered, [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            if b - a - 1 >= seed:
                heapq.heappush(heap, (-int(b - a - 1), i + int(a), j + int(a)))
    return out


def _contained(items: Items, column: pa.Array, share: float):
    """(row, item index, coverage, tiles) of the documents of a text column that contain an item."""
    for row, data, offsets in text.slices(column):
        data = text.LOWER[data]
        starts, ends, first = text.words(data, offsets)
        hashed = text.span_hashes(data, starts, ends)
        seeds, at = text.windows(hashed, first, SEED)
        if not len(seeds) or not len(items.seeds):
            continue
        where = np.minimum(np.searchsorted(items.seeds, seeds), len(items.seeds) - 1)
        hit = items.seeds[where] == seeds
        where, at = where[hit], at[hit]
        if not len(at):
            continue
        doc = np.searchsorted(first, at, side="right") - 1
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            k = doc[a]
            yield from ((row + int(k), *x) for x in _judge(
                items, hashed[first[k]:first[k + 1]], where[a:b], at[a:b] - first[k], share))


def _judge(items: Items, doc: np.ndarray, where: np.ndarray, places: np.ndarray, share: float):
    lengths = items.begin[where + 1] - items.begin[where]
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.repeat(items.begin[where] - start, lengths) + np.arange(lengths.sum())
    item, inside, outside = items.item[at], items.place[at], np.repeat(places, lengths)
    for k in np.unique(item):
        own = item == k
        words = items.words[items.first[k]:items.first[k + 1]]
        # no tiling covers more than the words below shared seeds
        reach = np.zeros(len(words) + SEED, dtype=np.int64)
        distinct = np.unique(inside[own])
        reach[distinct] += 1
        reach[distinct + SEED] -= 1
        if (np.cumsum(reach)[:len(words)] > 0).sum() < share * len(words):
            continue
        found = tiles(words, doc, np.stack([inside[own], outside[own]], axis=1))
        coverage = sum(n for _, _, n in found) / len(words)
        if coverage >= share:
            yield int(k), coverage, found


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of bounded size, by a hash of the rows."""
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [own.where(part == k) if n > 1 else own for k in range(n)]


_FOUND = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("tiles", T.ArrayType(T.ArrayType(T.IntegerType())))]))


def _with_found(docs: DataFrame, benchmark: DataFrame, share: float, name: str) -> DataFrame:
    """docs with the array `name` of contained items; one pass over the rows per block."""
    spark = docs.sparkSession
    at, names = docs.columns.index("text"), [*docs.columns, name]
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()),
                                ("tiles", pa.list_(pa.list_(pa.int32())))]))

    def searching(items, first):
        def run(batches):
            for batch in batches:
                found = [[] for _ in range(batch.num_rows)] if first \
                    else batch.column(batch.num_columns - 1).to_pylist()
                for row, k, coverage, tiling in _contained(items.value, batch.column(at), share):
                    found[row].append({"item_id": items.value.ids[k], "coverage": coverage,
                                       "tiles": [list(t) for t in tiling]})
                columns = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow)],
                                                 names=names)
        return run

    out = docs
    for k, block in enumerate(_blocks(benchmark)):
        table = block.toArrow()  # at most about BLOCK_BYTES of text
        items = spark.sparkContext.broadcast(prepare(*(c.to_pylist() for c in table.columns)))
        out = out.mapInArrow(searching(items, k == 0),
                             T.StructType([*docs.schema.fields, T.StructField(name, _FOUND)]))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, coverage, item_id, item_ids, n_tiles) of every row.

    coverage, item_id and n_tiles are those of the best covered item (null without one); item_ids
    are all contained items in ascending order.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    found = _with_found(own, benchmark, share, "found").select("doc_id", "found")
    best = F.expr("array_sort(found, (l, r) -> CASE WHEN l.coverage > r.coverage THEN -1 "
                  "WHEN l.coverage < r.coverage THEN 1 "
                  "WHEN coalesce(l.item_id, 9223372036854775807) "
                  "< coalesce(r.item_id, 9223372036854775807) THEN -1 "
                  "WHEN coalesce(l.item_id, 9223372036854775807) "
                  "> coalesce(r.item_id, 9223372036854775807) THEN 1 ELSE 0 END)")
    return found.withColumn("best", F.get(best, F.lit(0))).select(
        "doc_id", (F.size("found") > 0).alias("contaminated"),
        F.col("best.coverage").alias("coverage"), F.col("best.item_id").alias("item_id"),
        F.array_sort(F.expr("transform(found, x -> x.item_id)")).alias("item_ids"),
        F.size("best.tiles").alias("n_tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = COVERAGE) -> DataFrame:
    """Rows of docs that contain no benchmark item, with the same columns."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return _with_found(docs, benchmark, share, name).where(F.size(F.col(name)) == 0).drop(name)
