"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller neighbours (large star, then small
star) until the table is a set of stars around the smallest node of each
component. Every round is a pair of joins on the node; nothing is collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedit.llm.common import stored


def find(parent: dict, x):
    """Root of ``x``, halving the path on the way."""
    while (p := parent.get(x, x)) != x:
        parent[x] = x = parent.get(p, p)
    return x


def _contract(batches):
    """Links of one partition as stars: fewer links for the first round."""
    for batch in batches:
        parent: dict[int, int] = {}
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()),
                                          pa.array([find(parent, x) for x in nodes], pa.int64())], names=["a", "b"])


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root), root the smallest node; nodes without links don't appear."""
    links = links.where("a <> b").mapInArrow(_contract, "a long, b long")
    links = stored(links.distinct(), "stars")       # a > b throughout
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(low, both["a"] == low["k"]).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large["a"] == least["k"])
        small = small.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        links = stored(small.where("a <> b").distinct(), "stars")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
