"""Rows that every document operator has to cope with."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("found", T.StringType()),
    T.StructField("drops", T.StringType()), T.StructField("component", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("bucket", T.StringType())])
EXTRA = ("x",) * 8


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 7)))
                    for _ in range(n))


def edge_rows(rng: random.Random) -> list[tuple[int | None, str | None]]:
    long = "\n".join(sentence(rng, 12) for _ in range(4000))
    same = sentence(rng, 40)
    return [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, long), (5, same), (6, same), (6, same),
            (None, same), (None, None), (7, "a"), (8, "A b"), (9, "a B"), (10, "\n" + same + "\n\n"),
            (11, "Ärger ﬁn ▁   naïve 日本語 🙂 <|endoftext|> don't"), (-12, "a b c d e"),
            (13, "x" * 9000), (14, "\x00\x01 ﻿ z"), (15, "word " * 500)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, *EXTRA) for i, t in rows],
                                 SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Sets:
    """Union-find for brute-force components; the root is the smallest member."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
