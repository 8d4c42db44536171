"""Connected components of an edge table by alternating star contractions, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import discard, materialise


def _state(edges: DataFrame) -> tuple:
    """Order-free fingerprint of the edges, one small row."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every end of an edge (a, b); component is the smallest id reachable.

    A round is a large star (every larger neighbour is linked to the smallest neighbour) and a small
    star (every smaller one too). Neighbourhoods are never collected: the minimum is pre-aggregated
    and joined back, and a hub's rows form the splittable side of that join. Each round is a written
    table in the shared folder, and the one before it is deleted. Loops and repeated edges have no effect; without edges the result is
    empty.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u > v").distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.select(F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
            F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.*")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"),
                                                          F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, now = now, materialise(small.where("u > v").distinct(), name)
        discard(old)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
