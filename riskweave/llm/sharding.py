"""Shards of nearly equal bytes by a minimax contiguous partition of atomic groups.

Law `bytes`: the size of a row is the UTF-8 length of its text plus 1. Rows of equal text form a
group, and groups fall by a hash of the text into a fixed number of atomic buckets, so that copies
are never separated and the sizes to be partitioned have a bound that does not grow with the data.
The ordered bucket sizes are cut into contiguous runs: a binary search over whole numbers finds the
smallest capacity for which a greedy walk needs no more than the wanted number of shards. A bucket
that is more than an equal share is a shard by itself and the rest is shared by the others; smaller
ones far above the mean (hot groups) are spread over the order first, largest to the emptiest run.

Slots number the rows of a shard without gaps: each bucket, split further by a hash of doc_id if it
holds many rows, numbers its own rows, and offsets are running sums of the counts of these cells.

Defined cases: a null text counts as empty (size 1, checksum 0). Rows with null or repeated doc_id
get slots of their own. With fewer buckets in use than shards some shards stay empty. An empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

BUCKETS = 1 << 16
#: Rows that one cell numbers by itself, or a bucket's mean if that is more: there are never more than
#: twice BUCKETS cells.
CELL_ROWS = 1_000
#: A bucket is hot above this part of a shard's mean size.
HOT_SHARE = 64


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least capacity with which `shards` contiguous runs hold all sizes."""
    low, high = max([*sizes, -(-sum(sizes) // shards)], default=0), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(cut(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], capacity: int) -> list[int]:
    """Number of sizes in each run when every run is filled greedily up to the capacity."""
    runs, load, count = [], 0, 0
    for size in sizes:
        if count and load + size > capacity:
            runs.append(count)
            load = count = 0
        load, count = load + size, count + 1
    return [*runs, count] if count else runs


def spread_order(sizes: dict[int, int], shards: int) -> list[int]:
    """Order of buckets: hot ones dealt to the runs, each run filled up with the others in order."""
    total = sum(sizes.values())
    hot = sorted((b for b in sizes if sizes[b] * shards * HOT_SHARE > total),
                 key=lambda b: (-sizes[b], b))
    loads = [(0, s) for s in range(shards)]
    runs: list[list[int]] = [[] for _ in range(shards)]
    for b in hot:
        load, s = heapq.heappop(loads)
        runs[s].append(b)
        heapq.heappush(loads, (load + sizes[b], s))
    load_of = {s: load for load, s in loads}
    is_hot = set(hot)
    rest = iter(sorted(b for b in sizes if b not in is_hot))
    order: list[int] = []
    for s in range(shards):
        order += runs[s]
        load = load_of[s]
        while load * shards < total or s == shards - 1:
            b = next(rest, None)
            if b is None:
                break
            order.append(b)
            load += sizes[b]
    return [*order, *rest]


def plan(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of every bucket; a bucket above the mean of what is left is a shard by itself."""
    left, total, out, shard = dict(sizes), sum(sizes.values()), {}, 0
    for b in sorted(sizes, key=lambda b: (-sizes[b], b))[:shards - 1]:
        if sizes[b] * (shards - shard) < total:
            break
        out[b] = shard
        total -= left.pop(b)
        shard += 1
    order = spread_order(left, shards - shard)
    ordered = [left[b] for b in order]
    ends = list(accumulate(cut(ordered, smallest_capacity(ordered, shards - shard))))
    run = 0
    for i, b in enumerate(order):
        while i >= ends[run]:
            run += 1
        out[b] = shard + run
    return out


def _sized(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _table(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A table of whole numbers, at most one row per cell."""
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=names))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    spark = docs.sparkSession
    sized = _sized(docs)
    # at most BUCKETS rows of three numbers, pre-aggregated by every task
    totals = sized.groupBy("bucket").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    found = {r["bucket"]: (r["s"], r["n"]) for r in totals.collect()}
    shard_of = plan({b: s for b, (s, _) in found.items()}, shards)
    cell = max(CELL_ROWS, -(-sum(n for _, n in found.values()) // BUCKETS))
    rows = [(b, shard_of[b], -(-n // cell)) for b, (_, n) in found.items()]
    lookup = _table(spark, rows, ["bucket", "shard", "parts"])
    placed = sized.join(broadcast(lookup), "bucket").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("parts")).cast("int"))
    counts = {(r["bucket"], r["part"]): r["n"] for r in
              placed.where("parts > 1").groupBy("bucket", "part")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, used = [], [0] * shards
    for b, shard, parts in sorted(rows):
        for part in range(parts):
            n = counts.get((b, part), 0) if parts > 1 else found[b][1]
            offsets.append((b, part, used[shard]))
            used[shard] += n
    starts = _table(spark, offsets, ["bucket", "part", "start"])
    within = Window.partitionBy("bucket", "part").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("place", F.row_number().over(within) - 1)
            .join(broadcast(starts), ["bucket", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                    F.col("shard").cast("int").alias("shard"),
                    (F.col("start") + F.col("place")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write docs as one folder per shard, all columns, with the shard in the column shard_."""
    spark = docs.sparkSession
    totals = _sized(docs).groupBy("bucket").agg(F.sum("size").alias("s")).collect()
    shard_of = plan({r["bucket"]: r["s"] for r in totals}, shards)
    lookup = _table(spark, list(shard_of.items()), ["bucket_", "shard_"])
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    (docs.withColumn("bucket_", F.pmod(F.xxhash64(body), F.lit(BUCKETS)).cast("int"))
     .join(broadcast(lookup), "bucket_").drop("bucket_").write.mode("errorifexists")
     .partitionBy("shard_").parquet(path))
