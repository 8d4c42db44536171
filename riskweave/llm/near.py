"""Exact components of similar texts from banded signatures, without pairs of whole buckets.

1. Band rows (key, id) are shuffled once. A key that is frequent within one batch is hot: all but its
   smallest id of that batch go to a bucket of their own, tied to that id, so a key that a third of
   all texts share arrives as one row per batch.
2. In sorted order every bucket yields its members next to its smallest id: a star, not all pairs. Rows
   that carry marks (three bits of every register) are compared within their bucket first: two agree that
   have as many of them in common as the estimate's floor asks for. What agreement connects is a bucket
   of its own, and a member that agrees with no other one goes. Equal registers have equal bits, so no
   pair that passes the estimate is lost; texts that only share common shingles, which meet the more
   often the larger the corpus, end here as 56 bytes a row.
3. Every member is verified with the star partner it shares most bands with; components follow.
4. Buckets that still hold several components are the rest: there, texts outside the largest
   component meet the texts of other components in blocks. A block verifies on full sets what passes
   the estimate and is not yet connected, unites at once, and returns only the links that united two
   components: fewer rows than members, however many of them are similar. Then every pair that shares
   a band and passes the estimate is verified or connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from riskweave.llm import sketch
from riskweave.llm.components import components
from riskweave.llm.text import mix
from riskweave.session import discard, materialise

#: Ids that a broadcast filter may hold (16 bytes each on an executor); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows of a key within one batch from which on the key counts as hot.
HOT_ROWS = 64
#: Texts of one side in a block of the rest.
BLOCK = 512
#: The blocks of the rest are worked on in slices, one after the other: what a slice shuffles is gone
#: before the next one starts. A slice has about this share of the rows that the texts in blocks have,
#: or SLICE_ROWS if that is more.
SLICE_SHARE = 0.5
SLICE_ROWS = 50_000
Facts = Callable[[DataFrame], DataFrame]
#: Text column -> (sorted distinct shingle hashes of each text, offsets)
Shingles = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
BANDS_SCHEMA = "key long, sub long, id long"
#: Members of a bucket that are compared with each other by their marks; a larger bucket stays whole.
MARKED_MEMBERS = 16_384
#: Neighbours that all rows of a batch are compared with at once; larger buckets are gone through.
_NEIGHBOURS = 32
_PER_WORD = 21  # registers in a word of marks, three bits of each
_THIRD = np.uint64(0x1249249249249249)
_HOT = np.uint64(1 << 63)  # in a word of marks: members of this key are elsewhere


@dataclass(frozen=True)
class Banding:
    """Signature and threshold: P(miss) = (1 - J^rows)^bands for a pair of similarity J.

    Bands are cut from `buckets` registers, similarity is estimated from `fine` registers.
    """
    buckets: int
    bands: int
    rows: int
    percent: int
    floor: float
    fine: int

    def __post_init__(self):
        if self.bands * self.rows > self.buckets or self.rows > 4:
            raise ValueError("bands x rows must fit the buckets, with at most four rows")


def marks(signature: np.ndarray) -> np.ndarray:
    """uint64 array (texts, words): the three lowest bits of every register, _PER_WORD to a word."""
    n, registers = signature.shape
    words = -(-registers // _PER_WORD)
    low = np.zeros((n, words * _PER_WORD), dtype=np.uint64)
    low[:, :registers] = signature & np.uint16(7)
    low <<= np.tile(np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(3), words)
    return np.bitwise_or.reduce(low.reshape(n, words, _PER_WORD), axis=2)


def marked_schema(banding: Banding) -> str:
    return BANDS_SCHEMA + "".join(f", m{k} long" for k in range(-(-banding.buckets // _PER_WORD)))


def band_batch(ids: np.ndarray, signature: np.ndarray, banding: Banding,
               some: slice | None = None) -> pa.RecordBatch:
    """Rows (key, sub, id) of a batch, with hot keys put below their smallest id. With some: those of
    some of the bands, with the marks of the text."""
    keys = sketch.band_keys(signature, banding.bands, banding.rows)
    keys = keys if some is None else keys[:, some]
    bands, keys = keys.shape[1], keys.ravel()
    who = np.repeat(ids.astype(np.int64), bands)
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
    keys, who = keys[fresh], who[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    size = np.diff(np.append(start, len(keys)))
    lead = np.zeros(len(keys), dtype=np.int64)
    hot = np.repeat(size >= HOT_ROWS, size)
    lead[hot] = np.repeat(who[start], size)[hot] if len(keys) else 0
    is_lead = np.zeros(len(keys), dtype=bool)
    is_lead[start] = True
    sub = np.where(hot, lead, np.int64(-1))
    extra = hot & is_lead
    columns = [np.concatenate([keys, keys[extra]]),
               np.concatenate([sub, np.full(int(extra.sum()), -1, np.int64)]),
               np.concatenate([who, who[extra]])]
    names = ["key", "sub", "id"]
    if some is not None:
        mark = marks(signature)[order[fresh] // bands]
        leads = mark[extra]
        leads[:, -1] |= _HOT
        mark = np.concatenate([mark, leads]).view(np.int64)
        columns += [np.ascontiguousarray(m) for m in mark.T]
        names += [f"m{k}" for k in range(mark.shape[1])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _agree(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Do the marks differ in `most` registers or fewer?"""
    x = a ^ b
    x |= (x >> np.uint64(1)) | (x >> np.uint64(2))
    return np.bitwise_count(x & _THIRD).sum(axis=-1, dtype=np.int64) <= most


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of the group of every row, from that before and further links."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _partnered(key: np.ndarray, sub: np.ndarray, who: np.ndarray, mark: np.ndarray, most: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of whole buckets: the rows whose marks agree with those of another id of their
    bucket, each once, and a key of their own for those that agreement connects. Buckets whose key has
    members elsewhere, and large ones, stay whole."""
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (key[1:] == key[:-1]) & (sub[1:] == sub[:-1])
    once = np.ones(len(key), dtype=bool)
    once[1:] = ~same[1:] | (who[1:] != who[:-1])
    rows = np.flatnonzero(once)
    mark = mark[rows]
    start = np.flatnonzero(~same[rows])
    size = np.diff(np.append(start, len(rows)))
    whole = (sub[rows][start] != -1) | (size > MARKED_MEMBERS)
    whole |= np.logical_or.reduceat((mark[:, -1] & _HOT) != 0, start)
    stays = np.repeat(whole, size)
    group = np.arange(len(rows))  # the first row of its group
    after = np.repeat(start + size, size) - group - 1  # rows behind in the bucket
    after[stays] = 0
    left = np.flatnonzero(after)
    for step in range(1, _NEIGHBOURS + 1):
        left = left[after[left] >= step]
        if not len(left):
            break
        new = left[group[left] != group[left + step]]
        new = new[_agree(mark[new], mark[new + step], most)]
        group = _united(group, new, new + step)
    for b in np.flatnonzero(~whole & (size > _NEIGHBOURS + 1)).tolist():
        bucket, n = slice(start[b], start[b] + size[b]), int(size[b])
        own = group[bucket] - start[b]
        # rows of the largest group meet the others as their partners
        outside = np.flatnonzero(own != np.argmax(np.bincount(own, minlength=n)))
        part = max(1, (1 << 17) // n)
        for k in range(0, len(outside), part):
            some = outside[k:k + part]
            i, j = np.nonzero(_agree(mark[bucket][some][:, None], mark[bucket][None], most))
            own = _united(own, some[i], j)
        group[bucket] = own + start[b]
    several = np.bincount(group, minlength=len(rows))[group] > 1
    out = np.flatnonzero(stays | several)
    out = out[np.argsort(np.where(stays, np.repeat(start, size), group)[out], kind="stable")]
    split = (mix(key[rows].view(np.uint64) ^ mix(who[rows][group].view(np.uint64)))).view(np.int64)
    return rows[out], np.where(stays, key[rows], split)[out]


def _promising(most: int):
    """Rows (key, sub, id) that ``_partnered`` keeps, those of a bucket together and ids in order; the
    input has marks and is sorted by (key, sub, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one bucket
        large = None  # a bucket that goes on and stays whole
        for batch in batches:
            if not batch.num_rows:
                continue
            key, sub = (batch.column(i).to_numpy() for i in range(2))
            last = (key[-1], sub[-1])
            more = (key == key[-1]) & (sub == sub[-1])
            cut = len(more) - int(more.sum())  # equal rows are together
            if large is not None:
                old = int(((key == large[0]) & (sub == large[1])).sum())
                yield batch.slice(0, old).select(["key", "sub", "id"])
                if old == batch.num_rows:
                    continue
                batch, cut, large = batch.slice(old), cut - old, None
            if held and (cut or (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != last):
                yield kept([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield kept([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            if sum(x.num_rows for x in held) > MARKED_MEMBERS and _ids(held) > MARKED_MEMBERS:
                yield from (x.select(["key", "sub", "id"]) for x in held)
                held, large = [], last
        if held:
            yield kept(held)

    def kept(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        key, sub, who, *mark = (rows.column(i).to_numpy() for i in range(rows.num_columns))
        at, keys = _partnered(key, sub, who, np.stack(mark, axis=1).view(np.uint64), most)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sub[at]), pa.array(who[at])],
                                          names=["key", "sub", "id"])
    return run


def _ids(batches: list[pa.RecordBatch]) -> int:
    return len(np.unique(np.concatenate([x.column("id").to_numpy() for x in batches])))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets with two ids or more; the input is sorted by (key, sub, id)."""
    open_key, head, written = None, 0, False  # the bucket that the last batch ended in
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub, who = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
        new[0] = (key[0], sub[0]) != open_key
        bucket = np.cumsum(new)  # 0 is the open one
        heads = np.concatenate([np.array([head], np.int64), who[new]])
        first = heads[bucket]
        other = who != first
        several = np.zeros(len(heads), dtype=bool)
        several[bucket[other]] = True
        late = several[0] and not written  # the open bucket's first id was held back
        several[0] |= written
        wanted = other | (new & several[bucket])
        out = [np.concatenate([np.array([before] if late else [], np.int64), x[wanted]])
               for before, x in zip((*(open_key or (0, 0)), head, head), (key, sub, who, first))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out],
                                         names=["key", "sub", "id", "first"])
        open_key, head, written = (key[-1], sub[-1]), first[-1], bool(several[bucket[-1]])


def buckets(bands: DataFrame, banding: Banding) -> DataFrame:
    """(key, sub, id, first) of buckets with several ids, from band rows; one shuffle. Of rows with
    marks only those that agree with another one of their bucket."""
    dealt = bands.repartition("key", "sub").sortWithinPartitions("key", "sub", "id")
    stars = _stars
    if len(bands.columns) > 3:
        if banding.fine != banding.buckets:
            raise ValueError("marks are taken from the registers of the estimate")
        least = int(np.ceil(banding.floor * banding.buckets - 1e-9))  # equal registers at the floor
        promising = _promising(banding.buckets - least)
        stars = lambda batches: _stars(promising(batches))
    return dealt.mapInArrow(stars, "key long, sub long, id long, first long")


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is in ids (written table of distinct ids), broadcast when few."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(broadcast(ids) if few else ids, "id", "left_semi")


def with_sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs (a, b) with every other column x of facts (id, x, ...) as a_x and b_x."""
    names = [c for c in facts.columns if c != "id"]
    for side in "ab":
        own = facts.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names])
        pairs = pairs.join(own, side)
    return pairs


def _estimated(floor: float, buckets_n: int):
    def run(batches):
        for x in batches:
            if x.num_rows:
                a, b = (_matrix(x.column(f"{s}_sketch"), buckets_n) for s in "ab")
                est = sketch.similarity(a, b, x.column("a_size").to_numpy(),
                                        x.column("b_size").to_numpy())
                keep = est >= floor
                yield pa.RecordBatch.from_arrays(
                    [x.column("a").filter(pa.array(keep)), x.column("b").filter(pa.array(keep))],
                    names=["a", "b"])
    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16)
    return flat.reshape(len(column), width)


class _Forest:
    """Components of a block by number, united as links are found."""

    def __init__(self, components: np.ndarray):
        self.start = np.unique(components, return_inverse=True)[1].ravel()
        self.parent = np.arange(self.start.max() + 1)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        """Present component of every row."""
        found = self.parent[self.start[rows]]
        while (self.parent[found] != found).any():
            found = self.parent[found]
        return found

    def unite(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def _common(one: np.ndarray, sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a sorted set with the sets of the given rows."""
    starts, sizes = sets[1][rows], sets[1][rows + 1] - sets[1][rows]
    ends = np.cumsum(sizes)
    values = sets[0][np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
    place = np.minimum(np.searchsorted(one, values), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[place] == values)])
    return hits[ends] - hits[ends - sizes]


def _rest(banding: Banding, shingles: Shingles):
    """Links of a block that unite components: outsiders with texts of other components.

    The input is sorted by block; a block has some BLOCK outsiders and 4 x BLOCK members at most, up
    to the unevenness of the hash that deals them.
    """
    def pairs(rows: dict[str, np.ndarray], texts: pa.Array):
        outside = np.flatnonzero(rows["outside"])
        inside = np.flatnonzero(~rows["outside"])
        forest, sets, found = _Forest(rows["component"]), None, []
        for i in outside:
            own = forest.roots(np.array([i]))[0]
            differ = inside[forest.roots(inside) != own]
            if not len(differ):
                continue
            equal = (rows["sketch"][differ] == rows["sketch"][i]).mean(axis=1)
            differ = differ[equal >= banding.floor]  # the correction only lowers it
            if not len(differ):
                continue
            est = sketch.similarity(
                rows["sketch"][differ], np.repeat(rows["sketch"][i][None], len(differ), axis=0),
                rows["size"][differ], np.repeat(rows["size"][i], len(differ)))
            differ = differ[est >= banding.floor]
            if not len(differ):
                continue
            if sets is None:
                sets = shingles(texts)
            one = sets[0][sets[1][i]:sets[1][i + 1]]
            common = _common(one, sets, differ)
            union = len(one) + sets[1][differ + 1] - sets[1][differ] - common
            linked = differ[100 * common >= banding.percent * union]
            # one link to each other component that is reached
            roots, at = np.unique(forest.roots(linked), return_index=True)
            for root, k in zip(roots.tolist(), at.tolist()):
                now = int(forest.roots(np.array([i]))[0])
                if root != now:
                    forest.unite(now, root)
                    found.append((rows["id"][i], rows["id"][linked[k]]))
        if not found:
            return None
        both = np.sort(np.array(found, dtype=np.int64), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])],
                                          names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            block = table.column("block").to_numpy()
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on
            yield from blocks(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held).combine_chunks())

    def blocks(table: pa.Table):
        if not table.num_rows:
            return
        block = table.column("block").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        columns = {c: table.column(c).to_numpy(zero_copy_only=False)
                   for c in ("id", "component", "size", "outside")}
        for a, b in zip(edge[:-1], edge[1:]):
            part = {c: v[a:b] for c, v in columns.items()}
            part["sketch"] = _matrix(table.column("sketch").slice(a, b - a).combine_chunks(),
                                     banding.fine)
            found = pairs(part, table.column("text").slice(a, b - a).combine_chunks())
            if found is not None:
                yield found
    return run


def _verified(similar: Callable[[pa.Array, pa.Array], np.ndarray]):
    def run(batches):
        for x in batches:
            if x.num_rows:
                keep = pa.array(similar(x.column("a_text"), x.column("b_text")))
                yield pa.RecordBatch.from_arrays(
                    [x.column("a").filter(keep), x.column("b").filter(keep)], names=["a", "b"])
    return run


def link(bands: DataFrame | list[DataFrame], prepare: Callable[[DataFrame], tuple[Facts, Facts]],
         similar: Callable[[pa.Array, pa.Array], np.ndarray], shingles: Shingles,
         banding: Banding) -> DataFrame:
    """(id, component) of ids linked with another one; ids without a link are absent.

    bands: rows of ``band_batch``, or several tables of them with the rows of some bands each, which are
    shuffled one after the other. prepare(ids) gets all ids that share a band with another one and
    returns two functions of a table of some of them: one gives (id, size, sketch), the other
    (id, text); a third one, if there is one, gives both, without a join. similar says for two text
    columns which rows are linked, shingles gives their sets.
    """
    def ids_of(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.select(F.col("a").alias("id"))
                           .unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "ids")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = ids_of(pairs)
        found = materialise(with_sides(pairs.select("a", "b"), texts(ids))
                            .mapInArrow(_verified(similar), "a long, b long"), "links")
        discard(ids)
        return found

    waves = [materialise(buckets(x, banding), "buckets")
             for x in (bands if isinstance(bands, list) else [bands])]
    members = reduce(lambda a, b: a.unionAll(b), waves)
    # one star partner per member, the one with most bands in common
    best = (members.where("id <> first").groupBy("id", "first").count()
            .groupBy(F.col("id").alias("b"))
            .agg((-F.max(F.struct("count", (-F.col("first")).alias("a")))["a"]).alias("a"))
            .select("a", "b"))
    best = materialise(best, "stars")
    if best.isEmpty():
        return best.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # a member's keys, at most two per band, as one row
    keys = materialise(members.groupBy("id").agg(F.collect_set("key").alias("keys")), "keys")
    for wave in waves:
        discard(wave)
    sketches, texts, *whole = prepare(keys.select("id"))
    ids = ids_of(best)
    likely = materialise(with_sides(best, sketches(ids)).mapInArrow(
        _estimated(banding.floor, banding.fine), "a long, b long"), "likely")
    discard(ids)
    links = verify(likely)
    discard(likely)
    labels = materialise(components(links), "labels")
    discard(links)

    blocks = _mixed(keys, labels, best)
    discard(keys)
    discard(best)
    if blocks.isEmpty():
        return labels
    ids = materialise(blocks.select("id").distinct(), "ids")
    facts = whole[0](ids) if whole else sketches(ids).join(texts(ids), "id")
    dealt = _dealt(blocks)
    slices = -(-dealt.count() // max(SLICE_ROWS, int(SLICE_SHARE * ids.count())))
    found = None
    for k in range(slices):
        # a text stands in many blocks: its copies for a slice are shuffled and gone with its query
        more = materialise(
            dealt.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == k).join(facts, "id")
            .repartition("block").sortWithinPartitions("block")
            .mapInArrow(_rest(banding, shingles), "a long, b long").distinct(), "more")
        found = more if found is None else found.unionAll(more)
    discard(blocks)
    discard(ids)
    if found.isEmpty():
        return labels
    known = labels.select(F.col("component").alias("a"), F.col("id").alias("b"))
    return materialise(components(known.unionAll(found)), "labels")


def _mixed(keys: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the blocks of each bucket.

    Similar texts share many bands: of buckets with the same members (by 128 bits) one is enough, and
    one of two members needs nothing more when tested (a, b) holds them.
    """
    known = (keys.join(labels, "id", "left")
             .select("id", F.coalesce("component", "id").alias("component"),
                     F.explode("keys").alias("key")))
    parts = known.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("count"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    mixed = (parts.groupBy("key").agg(
        F.max_by("component", "count").alias("main"), F.count(F.lit(1)).alias("parts"),
        F.sum("count").alias("n"), F.max("count").alias("most"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        .where("parts > 1"))
    # numbers only: texts or structs in the buffer would make the engine sort the rows
    once = mixed.groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key"))
    done = tested.select(F.col("a").alias("low"), F.col("b").alias("high"), F.lit(2).cast("long").alias("n"))
    wanted = mixed.join(once.join(done, ["n", "low", "high"], "left_anti").select("key"), "key",
                        "left_semi")
    return materialise(
        known.join(wanted.select("key", "main", "n", "most"), "key").select(
            "key", "id", "component", F.expr("component <> main").alias("outside"),
            F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("out_blocks"),
            F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("in_blocks")), "mixed")


def _dealt(blocks: DataFrame) -> DataFrame:
    """(block, id, component, outside): every outsider meets every member of its bucket in a block."""
    inside = blocks.select(
        "key", "id", "component", F.lit(False).alias("outside"),
        F.pmod(F.xxhash64("id"), F.col("in_blocks")).cast("int").alias("ib"),
        F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("ob"))
    outside = blocks.where("outside").select(
        "key", "id", "component", "outside",
        F.explode(F.sequence(F.lit(0), F.col("in_blocks") - 1)).alias("ib"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("out_blocks")).cast("int").alias("ob"))
    return inside.unionAll(outside).select(
        F.xxhash64("key", "ib", "ob").alias("block"), "id", "component", "outside")
