"""Merkle manifest of a table as a content-addressed graph, with proofs by descent from the root.

A leaf is the digest of a row's fields. The rows of one tree (here: one language) are ranked, and runs
of `ARITY` neighbours become the digest of their digests until one is left, the subroot; subroots in
the order of their trees become the root likewise. Every digest made is stored as a record
digest -> children, one table for each level.

Leaf requests are answered from those records alone. The descent starts with the root's digest; at
each level a digest is looked up, the digit of the rank (base `ARITY`) selects the child, and the
children not selected are put down as one segment of the path. Requests that share a prefix of digits
share the lookups: a node is looked up once, so a level has as many rows as it has nodes on the way to
a requested leaf. At a leaf the segments are reversed, which gives the siblings from leaf to root.

Scale: rows meet as digests only. Ranks come from a range sort with sums over its partitions. Level k
has rows / ARITY**k nodes and groups of at most `ARITY`. Paths are shuffled with the parents of leaves,
not with leaves. Equal rows give equal nodes, so one digest may stand at a third of all places:
records are kept once for each pack of `PACK` neighbouring nodes, and a lookup names the pack too,
which bounds the rows of one key. The driver sees the number of levels and the root.

Defined cases: a null field counts as `-`; null trees come first, then by UTF-8 bytes; within a tree
null doc_ids come first, rows of equal doc_id are ordered by leaf, and equal rows have the leaf twice.
A tree of one row has its leaf as subroot, a single tree its subroot as root, and their proofs skip
those levels; the proof of the only row is empty. An empty table has no root and no proofs. Other
columns are not read, and names of docs cannot clash with those used here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

ARITY = 8
#: Neighbouring nodes that share one copy of a record.
PACK = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BEFORE = Window.unboundedPreceding, -1


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the fields, each `-` or its byte count, a colon and its value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass(frozen=True)
class Manifest:
    """`leaves` (tree, rank, n, doc_id, leaf and kept columns), `trees` (tree, pos, n, subroot, height),
    records of the trees and of the tree over them by level from below, and the root's digest."""
    leaves: DataFrame
    trees: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with rank and number n of their tree, and (tree, pos, n) in the order of trees."""
    keys = ["tree", F.col("doc_id").asc_nulls_first(), "leaf", "place"]
    ordered = materialise(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("at", F.monotonically_increasing_id()).drop("place"),
                          "merkle-leaves")
    part = F.shiftright("at", 33)  # the partition, in ascending order
    # a row for each tree and for each further partition it reaches into
    spans = materialise(ordered.groupBy(part.alias("part"), "tree").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-spans")
    of_tree = Window.partitionBy("tree")
    starts = spans.select(
        "part", "tree", "first",
        F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(*_BEFORE)),
                   F.lit(0)).alias("before"), F.sum("rows").over(of_tree).alias("n"))
    ranked = (ordered.withColumn("part", part).join(starts, ["part", "tree"])
              .withColumn("rank", F.col("at") - F.col("first") + F.col("before"))
              .drop("part", "first", "before", "at"))
    trees = spans.groupBy("tree").agg(F.min("first").alias("first"), F.sum("rows").alias("n"))
    trees = trees.withColumn("part", F.shiftright("first", 33))
    # the window without a key has a row for each partition
    earlier = trees.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(
        F.sum("k").over(Window.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    return ranked, trees.join(earlier, "part").select(
        "tree", (F.col("earlier") + inside).alias("pos"), "n")


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Records level by level over (tree, idx, digest, n), and (tree, digest, height) of the roots."""
    levels, height = [], 0
    roots = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    while most > 1:
        kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))  # at most ARITY
        made = (nodes.where("n > 1")
                .groupBy("tree", F.expr(f"idx div {ARITY}").alias("parent"), "n")
                .agg(kids.getField("digest").alias("children"))
                .select("tree", F.col("parent").alias("idx"),
                        F.sha2(F.array_join("children", ""), 256).alias("digest"), "children",
                        F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n")))
        height += 1
        levels.append(materialise(made, f"merkle-level{height}"))
        nodes, most = levels[-1].drop("children"), -(-most // ARITY)
        roots = roots.union(nodes.where("n = 1").select("tree", "digest", F.lit(height)))
    return levels, roots


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang",
          order: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """Manifest of docs; `keep` names columns that go along with the leaves."""
    name = F.concat(F.lit("+"), F.col(tree).cast("string"))
    leaves = materialise(docs.select(
        F.coalesce(name, F.lit("")).alias("tree"), F.col(order).cast("long").alias("doc_id"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        *[c.alias(k) for k, c in (keep or {}).items()],
        F.monotonically_increasing_id().alias("place")), "merkle-rows")
    ranked, trees = _ranked(leaves)
    most, count = trees.agg(F.max("n"), F.count(F.lit(1))).first()
    levels, roots = _climb(ranked.select("tree", F.col("rank").alias("idx"),
                                         F.col("leaf").alias("digest"), "n"), most or 0)
    trees = materialise(trees.join(roots.withColumnRenamed("digest", "subroot"), "tree"),
                        "merkle-trees")
    top, root = _climb(trees.select(F.lit("").alias("tree"), F.col("pos").alias("idx"),
                                    F.col("subroot").alias("digest"), F.lit(count).alias("n")), count)
    return Manifest(ranked, trees, levels, top, root.first()["digest"] if count else None)


def _around(children: str, digit: str) -> Column:
    """The children that a digit does not select."""
    return F.expr(f"struct(array_join(slice({children}, 1, {digit}), '') AS left, "
                  f"array_join(slice({children}, {digit} + 2, {ARITY}), '') AS right)")


def _looked_up(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Frontier rows (tree, idx, digest, ...) with the children that the digest stands for."""
    pack = F.expr(f"idx div {PACK}").alias("pack")
    store = records.select("tree", pack, "digest", "children").dropDuplicates(
        ["tree", "pack", "digest"])
    return frontier.withColumn("pack", pack).join(store, ["tree", "pack", "digest"]).drop("pack")


def _step(frontier: DataFrame, records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One level down: a row for each child, its path longer by the other children."""
    carried = [c for c in frontier.columns if c not in ("idx", "digest", "path")]
    down = _looked_up(frontier, records).select(
        *carried, "idx", "path", "children", F.posexplode("children").alias("digit", "digest"))
    down = down.select(*carried, (F.col("idx") * ARITY + F.col("digit")).alias("idx"), "digest",
                       F.array_append("path", _around("children", "digit")).alias("path"))
    return down if wanted is None else down.join(wanted, ["tree", "idx"], "left_semi")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, leaf, kept columns, subroot, path) of all rows, or of those whose doc_id is in
    `wanted`; path has the siblings {left, right} at each level from the leaf to the root."""
    leaves, spark = manifest.leaves, manifest.leaves.sparkSession
    if wanted is not None:
        ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        leaves = leaves.join(ids, leaves["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    kept = [c for c in leaves.columns if c not in ("tree", "rank", "n")]
    frontier = spark.createDataFrame(
        [("", 0, manifest.root, [])] if manifest.root else [],
        "tree string, idx long, digest string, path array<struct<left:string,right:string>>")
    for records in reversed(manifest.top):
        frontier = _step(frontier, records)
    entering = frontier.select(F.col("idx").alias("pos"), "path").join(manifest.trees, "pos").select(
        "tree", F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "path",
        "subroot", "height")
    at = lambda k: entering.where(F.col("height") == k).drop("height")
    # nodes above a requested leaf; without a choice every node is
    above = None if wanted is None or not manifest.levels else materialise(
        leaves.select("tree", F.expr(f"rank div {ARITY}").alias("idx")).distinct(), "merkle-wanted")
    frontier = None
    for k in range(len(manifest.levels), 0, -1):
        frontier = at(k) if frontier is None else frontier.unionByName(at(k))
        if k > 1:
            branch = None if above is None else above.select(
                "tree", F.expr(f"idx div {ARITY ** (k - 2)}").alias("idx")).distinct()
            frontier = _step(frontier, manifest.levels[k - 1], branch)
    # trees of one row
    answers = leaves.where("n = 1").join(at(0), "tree").select(
        *kept, "subroot", F.reverse("path").alias("path"))
    if frontier is None:
        return answers
    # the last digit: requests wait at the parent, so that a path is shuffled once for its leaves
    asked = leaves.where("n > 1").groupBy("tree", F.expr(f"rank div {ARITY}").alias("idx")).agg(
        F.collect_list(F.struct(F.expr(f"int(rank % {ARITY})").alias("digit"), *kept)).alias("asks"))
    found = (_looked_up(frontier, manifest.levels[0]).join(asked, ["tree", "idx"])
             .select("subroot", "path", "children", F.explode("asks").alias("ask")))
    whole = F.reverse(F.array_append("path", _around("children", "ask.digit")))
    return found.select(*[F.col(f"ask.{c}").alias(c) for c in kept], "subroot",
                        whole.alias("path")).unionByName(answers)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf,
                       lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def checked(docs: DataFrame) -> DataFrame:
    """Every row's proof, checked against a copy of docs in which some texts were tampered with.

    The rows whose doc_id has a crc32 (of its decimal form) divisible by 3 are tampered with: A-Z in
    their text are lower-cased. A null doc_id has none and stays.
    """
    upper, lower = (bytes(range(c, c + 26)).decode() for c in (65, 97))
    tampered = [F.translate(F.col(f).cast("string"), upper, lower) if f == "text" else F.col(f)
                for f in FIELDS]
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(tampered))
    manifest = build(docs, keep={"forged": forged})
    root = F.lit(manifest.root).cast("string")
    start = F.coalesce("forged", "leaf")
    return proofs(manifest).select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias(
            "proof_sha256"), folded(start, F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
