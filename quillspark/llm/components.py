"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (a, b: long; direction is of no matter).

    Alternating star steps: neighbours are hung on the least node around them, first the greater ones, then the others,
    until nothing moves: about log of the longest path in rounds. Minima combine before each shuffle; they and each round's
    edges are written to the shared folder, so that both sides of the joins are plain shuffles, whose hot nodes adaptive
    execution splits. Nothing is collected but one pair of sums a round.
    """
    now = materialize(edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = materialize(both.groupBy(F.col("lo").alias("x")).agg(F.min("hi").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        # greater neighbours of x go to the least node around x
        large = materialize(now.join(least, now["lo"] == least["x"]).select(F.col("m").alias("lo"), "hi").where("lo != hi").distinct(), "edges")
        # lesser neighbours of x, and x, go to the least of them
        least2 = materialize(large.groupBy(F.col("hi").alias("x")).agg(F.min("lo").alias("m")), "least")
        small = large.join(least2, large["hi"] == least2["x"]).select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo != hi").distinct()
        new = materialize(small, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        for done in (now, least, large, least2):
            discard(done)
        now = new
        if mark == before:
            break
        before = mark
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
