"""Bootstrap metrics of many score sets, with a vector of replicate weights for each cell.

Resampling rows with replacement is replaced by an independent Poisson(1) weight per row and
replicate. Rows with the same label and the same scores form a cell, and a cell of n rows draws
Poisson(n) once. A weight is a function of (cell, replicate), so that every set sees the same
resample, a retried task repeats it, and weights need not be shuffled: each task draws the weights of
its cells as numpy blocks.

Sets with few distinct scores (LEVELS for all of them) share the draws: a task draws the weights of a
group of cells once and adds them up by score and label for every such set; the sums of the groups,
whose size is that of the scores, are added and give the metrics.

The cells of any other set are dealt into buckets of ascending scores (sets x cells rows, whatever the
number of replicates):

1. Bucket bounds are exact: a histogram with running sums cuts a set's scores every so many cells.
   A score with more cells than that is alone at the end of its bucket and is added up in parts.
2. Every bucket sums its positive and negative weight into arrays over the replicates.
3. Array-valued prefix sums over the buckets of a set (`buckets` rows) give what lies above and below.
4. Every bucket adds its share to the area, the average precision and the counts at the threshold.

Replicate 0 has every row once: the observed value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.hashing import strong_draws
from riskweave.operators.ranks import cut_points, default_buckets, prefix_sums, stacked
from riskweave.session import materialise, ship

#: (cells, replicates) -> matrix of numbers in [0, 1).
Draws = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Weights a task holds at once; with more cells in a bucket it takes fewer replicates at a time.
BLOCK_WEIGHTS = 1 << 21
#: Replicates of a block.
BLOCK = 100
#: Distinct scores, over all sets, that are added up score by score.
LEVELS = 1 << 12
#: Cells of a group, about; its sums have the size of the scores, so larger groups shuffle less.
GROUP = 1 << 19
#: Cells whose weights are drawn and added up at once.
CHUNK = 1 << 14
#: Buckets of a set; more cells make larger buckets.
MAX_BUCKETS = 1024
_PARTS, _UNSURE = 4096, 65535
_TOTALS = ("auc", "ap", "tp", "fp", "pos", "neg")
_ROW = "set int, bucket int, part int, score double, label int, cell long, n long"
_SUMS = "set int, bucket int, score double, pos array<double>, neg array<double>"
_OFFSETS = ("set int, bucket int, pos_above array<double>, neg_above array<double>, "
            "neg_below array<double>, score double, pos array<double>, neg array<double>")


@lru_cache(maxsize=4096)
def poisson_cdf(n: int) -> tuple[int, np.ndarray]:
    """Distribution function of Poisson(n) from a first count on; what lies outside is below 1e-30."""
    spread = 12 * math.sqrt(n) + 30
    low, high = max(0, math.floor(n - spread)), math.ceil(n + spread)
    first = low * math.log(n) - n - math.lgamma(low + 1)
    steps = math.log(n) - np.log(np.arange(low + 1, high + 1))
    return low, np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)])))


@lru_cache(maxsize=64)
def _lookup(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution function of Poisson(n) and the count of every 4096th part of [0, 1), or UNSURE
    where a step of the function lies inside."""
    low, cdf = poisson_cdf(n)
    parts = np.arange(_PARTS + 1) / _PARTS
    first = low + np.searchsorted(cdf, parts[:-1], side="right")
    last = low + np.searchsorted(cdf, np.nextafter(parts[1:], 0), side="right")
    return cdf, np.where((first == last) & (last < _UNSURE), first, _UNSURE).astype(np.uint16)


def _counts(u: np.ndarray, n: int) -> np.ndarray:
    """Poisson(n) counts of uniform numbers by inverting the distribution function."""
    low, _ = poisson_cdf(n)
    cdf, table = _lookup(n)
    out = table[(u * _PARTS).astype(np.uint16)]
    unsure = np.flatnonzero(out == _UNSURE)
    if low + len(cdf) >= _UNSURE:
        out = out.astype(np.int64)
    out.reshape(-1)[unsure] = low + np.searchsorted(cdf, u.reshape(-1)[unsure], side="right")
    return out


def cell_weights(cells: np.ndarray, sizes: np.ndarray, replicates: np.ndarray, draws: Draws
                 ) -> np.ndarray:
    """Matrix cells x replicates of Poisson(size) counts; the size itself for replicate 0."""
    u = draws(cells, replicates)
    distinct = np.unique(sizes).tolist()
    if len(distinct) == 1:
        out = _counts(u, distinct[0])
    else:
        out = np.empty(u.shape, np.int64)
        for n in distinct:
            rows = sizes == n
            out[rows] = _counts(u[rows], n)
    if (replicates == 0).any():
        out = out.astype(np.int64)
        out[:, replicates == 0] = sizes[:, None]
    return out


def _blocks(cells: int, replicates: int):
    step = max(1, min(BLOCK, BLOCK_WEIGHTS // max(cells, 1)))
    for low in range(0, replicates + 1, step):
        yield np.arange(low, min(low + step, replicates + 1))


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(rows.column(c).to_numpy() for c in ("score", "label", "cell", "n"))


def _array(values: np.ndarray) -> pa.Array:
    """A list column with one row for each row of a matrix."""
    values = np.atleast_2d(values)
    bounds = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.reshape(-1)))


def _matrix(column) -> np.ndarray:
    """The matrix behind a list column of equal lengths."""
    return np.array([np.asarray(v.values) for v in column])


def _sums(replicates: int, draws: Draws, one_score: bool):
    """Positive and negative weight of a group of cells, per replicate."""
    def run(key, rows):
        score, label, cell, n = _columns(rows)
        made = []
        for block in _blocks(len(cell), replicates):
            w = cell_weights(cell, n, block, draws).astype(np.float64)
            made.append((label @ w, (1 - label) @ w))
        pos, neg = (np.concatenate(x) for x in zip(*made))
        return pa.table({
            "set": pa.array([key[0].as_py()], pa.int32()),
            "bucket": pa.array([key[1].as_py()], pa.int32()),
            "score": pa.array([score[0] if one_score else None], pa.float64()),
            "pos": _array(pos), "neg": _array(neg)})
    return run


def _above(key, rows):
    """Array-valued prefix sums over the buckets of one set, and its frequent score of each."""
    bucket, score = rows.column("bucket").to_numpy(), rows.column("score").to_pylist()
    pos, neg = _matrix(rows.column("pos")), _matrix(rows.column("neg"))
    known = np.unique(bucket)
    at = np.searchsorted(known, bucket)
    total_pos, total_neg = (np.zeros((len(known), pos.shape[1])) for _ in range(2))
    np.add.at(total_pos, at, pos)
    np.add.at(total_neg, at, neg)
    hot_pos, hot_neg, hot = np.zeros_like(total_pos), np.zeros_like(total_neg), [None] * len(known)
    for k, s in enumerate(score):
        if s is not None:
            hot[at[k]] = s
            hot_pos[at[k]] += pos[k]
            hot_neg[at[k]] += neg[k]
    below = np.cumsum(total_neg, axis=0)
    pos_above = total_pos.sum(axis=0) - np.cumsum(total_pos, axis=0)
    return pa.table({
        "set": pa.array([key[0].as_py()] * len(known), pa.int32()),
        "bucket": pa.array(known, pa.int32()), "pos_above": _array(pos_above),
        "neg_above": _array(below[-1] - below), "neg_below": _array(below - total_neg),
        "score": pa.array(hot, pa.float64()), "pos": _array(hot_pos), "neg": _array(hot_neg)})


def _shares(replicates: int, draws: Draws, thresholds: list[float]):
    """What the scores of one bucket add to each total, per replicate."""
    def run(key, rows, offsets):
        which = key[0].as_py()
        pos_above, neg_above, neg_below, hot_pos, hot_neg = (
            _matrix(offsets.column(c))[0]
            for c in ("pos_above", "neg_above", "neg_below", "pos", "neg"))
        hot = offsets.column("score")[0].as_py()
        score, label, cell, n = _columns(rows)
        order = np.argsort(-score, kind="stable")
        score, label, cell, n = score[order], label[order][:, None], cell[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])[:len(score)])
        values = score[starts]
        place = 0 if hot is None else int(np.searchsorted(-values, -hot))
        if hot is not None:
            values = np.insert(values, place, hot)
        passed = values >= thresholds[which]
        out = {t: np.zeros(replicates + 1) for t in _TOTALS}
        for block in _blocks(len(cell), replicates):
            if len(starts):
                w = cell_weights(cell, n, block, draws).astype(np.float64)
                pos = np.add.reduceat(w * label, starts, axis=0)
                neg = np.add.reduceat(w * (1 - label), starts, axis=0)
            else:
                pos = neg = np.zeros((0, len(block)))
            if hot is not None:
                pos = np.insert(pos, place, hot_pos[block], axis=0)
                neg = np.insert(neg, place, hot_neg[block], axis=0)
            tp, passed_neg = pos_above[block] + np.cumsum(pos, axis=0), np.cumsum(neg, axis=0)
            fp = neg_above[block] + passed_neg
            lower = neg_below[block] + neg.sum(axis=0) - passed_neg
            for total, value in zip(_TOTALS, (
                    pos * (lower + neg / 2), pos * tp / np.maximum(tp + fp, 1e-300),
                    pos[passed], neg[passed], pos, neg)):
                out[total][block] = value.sum(axis=0)
        return pa.table({"set": pa.array([which], pa.int32()),
                         **{t: _array(v) for t, v in out.items()}})
    return run


# Sets with few distinct scores

def _added(w: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows order[start:next start] of a matrix of counts."""
    if not w.size:
        return np.zeros((len(starts), w.shape[1]), np.int64)
    longest = int(np.diff(np.append(starts, len(order))).max(initial=0))
    if w.dtype == np.uint16 and w.shape[1] % 4 == 0 and longest * int(w.max()) < 1 << 16:
        # four counts in a word: no sum reaches the next one
        words = np.take(np.ascontiguousarray(w).view(np.uint64), order, axis=0)
        return np.add.reduceat(words, starts, axis=0).view(np.uint16)
    return np.add.reduceat(np.take(w, order, axis=0).astype(np.int64), starts, axis=0)


def _level_sums(levels: list[np.ndarray], replicates: int, parts: int, draws: Draws):
    """(set, first, sums): weight by score and label of a group of cells in one share of the blocks of
    replicates; `first` is the first replicate of a block, rows 2 x score + label of its sums are laid
    end to end."""
    offset = np.cumsum([0, *(2 * len(x) for x in levels)])

    def run(key, rows):
        label, cell, n = (rows.column(c).to_numpy() for c in ("label", "cell", "n"))
        sized = np.argsort(n, kind="stable")  # chunks of cells of one size draw fastest
        label, cell, n = label[sized], cell[sized], n[sized]
        codes = [2 * np.searchsorted(x, rows.column(f"s{k}").to_numpy()[sized]) + label
                 for k, x in enumerate(levels)]
        blocks = [np.arange(a, min(a + BLOCK, replicates + 1))
                  for a in range(0, replicates + 1, BLOCK)][key[1].as_py()::parts]
        sums = [np.zeros((offset[-1], len(b)), np.int64) for b in blocks]
        for a in range(0, len(cell), CHUNK):
            some = slice(a, a + CHUNK)
            placed = []
            for code in codes:
                order = np.argsort(code[some], kind="stable")
                own = code[some][order]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                placed.append((order, starts, own[starts]))
            for block, total in zip(blocks, sums):
                w = cell_weights(cell[some], n[some], block, draws)
                for at, (order, starts, own) in zip(offset, placed):
                    total[at + own] += _added(w, order, starts)
        made = [(k, int(b[0]), total[offset[k]:offset[k + 1]].reshape(-1))
                for b, total in zip(blocks, sums) for k in range(len(levels))]
        ids, firsts, values = zip(*made) if made else ([], [], [])
        bounds = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.table({
            "set": pa.array(ids, pa.int32()), "first": pa.array(firsts, pa.int32()),
            "sums": pa.ListArray.from_arrays(
                pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))})
    return run


def _level_totals(levels: list[np.ndarray], limits: list[float], replicates: int):
    """The totals of every replicate from rows of ``_level_sums``; those of a set and block are
    together."""
    def finish(which: int, first: int, flat: np.ndarray) -> pa.RecordBatch:
        width = min(BLOCK, replicates + 1 - first)
        both = flat.reshape(-1, 2, width)[::-1].astype(np.float64)  # descending scores
        neg, pos = both[:, 0], both[:, 1]
        passed = levels[which][::-1] >= limits[which]
        tp, fp = np.cumsum(pos, axis=0), np.cumsum(neg, axis=0)
        lower = neg.sum(axis=0) - fp
        out = (pos * (lower + neg / 2), pos * tp / np.maximum(tp + fp, 1e-300), pos[passed],
               neg[passed], pos, neg)
        return pa.RecordBatch.from_arrays(
            [pa.array([which] * width, pa.int32()),
             pa.array(np.arange(first, first + width), pa.int32()),
             *(pa.array(x.sum(axis=0)) for x in out)], names=["set", "replicate", *_TOTALS])

    def run(batches):
        held, total = None, None
        for batch in batches:
            sums = batch.column("sums")
            for k, key in enumerate(zip(batch.column("set").to_pylist(),
                                        batch.column("first").to_pylist())):
                values = np.asarray(sums[k].values)
                if key == held:
                    total += values
                    continue
                if held is not None:
                    yield finish(*held, total)
                held, total = key, values.copy()
        if held is not None:
            yield finish(*held, total)
    return run


def _few_levels(cells: DataFrame, sets: list[str]) -> dict[str, np.ndarray]:
    """Distinct scores of the sets that have the fewest of them, at most LEVELS in all."""
    rows = stacked(cells, sets, name="set", value="score").select("set", "score").distinct()
    sizes = {r["set"]: r["n"] for r in rows.groupBy("set").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # one row for each set
    few, room = [], LEVELS
    for s in sorted(sizes, key=lambda s: (sizes[s], s)):
        room -= sizes[s]
        if room < 0:
            break
        few.append(s)
    found: dict[str, list[float]] = {s: [] for s in few}
    for r in rows.where(F.col("set").isin(few)).collect():  # at most LEVELS rows
        found[r["set"]].append(r["score"])
    return {s: np.sort(np.array(x)) for s, x in found.items()}


def _level_rows(cells: DataFrame, sets: list[str], levels: list[np.ndarray], limits: list[float],
                replicates: int, draws: Draws) -> DataFrame:
    """(set, replicate, totals) of sets with few distinct scores; `set` counts from 0 in `sets`."""
    spark = cells.sparkSession
    groups = max(1, -(-cells.count() // GROUP))
    blocks = -(-(replicates + 1) // BLOCK)
    parts = max(1, min(blocks, -(-2 * spark.sparkContext.defaultParallelism // groups)))
    # the shares of the replicates of a group are tasks of their own, so few cells keep all cores busy
    dealt = cells.select(
        F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "label", "cell", "n",
        *[F.col(s).alias(f"s{k}") for k, s in enumerate(sets)])
    sums = dealt.groupBy("group", "part").applyInArrow(
        _level_sums(levels, replicates, parts, draws), "set int, first int, sums array<bigint>")
    return (sums.repartition("set", "first").sortWithinPartitions("set", "first")
            .mapInArrow(_level_totals(levels, limits, replicates),
                        "set int, replicate int, " + ", ".join(f"{t} double" for t in _TOTALS)))


# Any other set

def _bounds(cells: DataFrame, sets: list[str], buckets: int
            ) -> tuple[list[np.ndarray], list[dict[int, tuple[float, int]]]]:
    """Lowest score of each bucket, and {bucket: (score, parts)} of the scores added up in parts."""
    hist = stacked(cells, sets, name="set", value="score").groupBy("set", "score").agg(
        F.count(F.lit(1)).alias("cells"))
    placed = prefix_sums(hist, ["set"], "score", ["cells"], cut_points(cells, sets))
    share = F.greatest(F.lit(1), F.ceil(F.col("cells_total") / buckets))
    rows = (placed.withColumn("share", share)
            .groupBy("set", F.floor(F.col("cells_before") / F.col("share")).alias("bucket"))
            .agg(F.min("score").alias("low"), F.max("cells").alias("most"),
                 F.max_by("score", "cells").alias("top"), F.first("share").alias("share"))
            .collect())  # at most sets x buckets rows
    lows, hot = [], []
    for s in sets:
        own = sorted((r for r in rows if r["set"] == s), key=lambda r: r["low"])
        lows.append(np.array([r["low"] for r in own]))
        hot.append({k: (r["top"], -(-r["most"] // r["share"])) for k, r in enumerate(own)
                    if r["most"] > r["share"]})
    return lows, hot


def _dealt(sets: list[str], lows: list[np.ndarray], hot: list[dict[int, tuple[float, int]]]):
    """Rows of ``_ROW``: every cell once for each set; part -1 unless its score is added up in parts."""
    def run(batches):
        for batch in batches:
            label, cell, n = (batch.column(c) for c in ("label", "cell", "n"))
            for k, s in enumerate(sets):
                score = batch.column(s).to_numpy(zero_copy_only=False)
                bucket = np.searchsorted(lows[k], score, side="right") - 1
                part = np.full(len(score), -1)
                for b, (value, parts) in hot[k].items():
                    at = np.flatnonzero((bucket == b) & (score == value))
                    part[at] = strong_draws(cell.to_numpy()[at], np.zeros(1, np.int64), 7)[:, 0] * parts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(score), pa.int32()), pa.array(bucket, pa.int32()),
                     pa.array(part, pa.int32()), pa.array(score), label, cell, n],
                    names=["set", "bucket", "part", "score", "label", "cell", "n"])
    return run


def replicate_metrics(wide: DataFrame, sets: list[str], thresholds: dict[str, float],
                      replicates: int = 2000, draws: Draws = strong_draws, label: str = "label",
                      id_col: str = "id") -> DataFrame:
    """(set, replicate, auc, ap, f1) of every score set in every replicate, 0 being all rows once.

    Rows need a label and a score of every set. A metric that a resample leaves undefined is null.
    """
    spark = wide.sparkSession
    ship(spark)
    named = [f"s{k}" for k in range(len(sets))]
    cells = materialise(
        wide.select(F.col(label).cast("int").alias("label"), F.col(id_col).cast("long").alias("id_"),
                    *[F.col(s).cast("double").alias(c) for s, c in zip(sets, named)])
        .groupBy("label", *named).agg(F.count(F.lit(1)).alias("n"), F.min("id_").alias("cell")),
        "cells")
    levels = _few_levels(cells, named)
    few, many = [c for c in named if c in levels], [c for c in named if c not in levels]
    limit = {c: float(thresholds[s]) for c, s in zip(named, sets)}
    made = []
    if few:
        made.append((few, _level_rows(cells, few, [levels[c] for c in few],
                                      [limit[c] for c in few], replicates, draws)))
    if many:
        made.append((many, _bucket_rows(cells, many, [limit[c] for c in many], replicates, draws)))
    title = dict(zip(named, sets))
    total = reduce(DataFrame.unionByName, [
        rows.withColumn("set", F.array(*[F.lit(title[c]) for c in some])[F.col("set")])
        for some, rows in made])
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    return total.select(
        "set", "replicate", F.try_divide(F.col("auc"), pos * neg).alias("auc"),
        F.try_divide(F.col("ap"), pos).alias("ap"),
        (2 * tp / F.greatest(tp + fp + pos, F.lit(1e-300))).alias("f1"))


def _bucket_rows(cells: DataFrame, sets: list[str], limits: list[float], replicates: int,
                 draws: Draws) -> DataFrame:
    """(set, replicate, totals) of sets with any number of distinct scores."""
    buckets = min(MAX_BUCKETS, default_buckets(cells.sparkSession))
    lows, hot = _bounds(cells, sets, buckets)
    dealt = cells.mapInArrow(_dealt(sets, lows, hot), _ROW)
    plain = dealt.where("part < 0")
    sums = plain.groupBy("set", "bucket").applyInArrow(_sums(replicates, draws, False), _SUMS)
    if any(hot):
        # the key has the part, so a frequent score is spread over several tasks
        parts = dealt.where("part >= 0").groupBy("set", "bucket", "part").applyInArrow(
            _sums(replicates, draws, True), _SUMS)
        sums = sums.unionByName(parts)
    offsets = materialise(sums.groupBy("set").applyInArrow(_above, _OFFSETS), "offsets")
    shares = plain.groupBy("set", "bucket").cogroup(offsets.groupBy("set", "bucket")).applyInArrow(
        _shares(replicates, draws, limits),
        "set int, " + ", ".join(f"{t} array<double>" for t in _TOTALS))
    rows = shares.select("set", F.posexplode(F.arrays_zip(*_TOTALS)).alias("replicate", "v"))
    return rows.groupBy("set", "replicate").agg(*[F.sum(f"v.{t}").alias(t) for t in _TOTALS])
