"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscan.llm.common import keep

ONE_TASK = 100_000  # so many links, counted, go through a round in one task without any shuffle


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every end of a link ``a, b``; ``root`` is the smallest node reachable.

    A round is a large-star and a small-star step, and is written to the
    shared folder; rounds end when the links no longer change. Each step groups
    by node with partial aggregates and joins the minima back, so no
    neighbourhood is ever collected. The links are counted in each round;
    ``ONE_TASK`` of them or fewer are not worth a shuffle.
    """
    links = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state or now[0] == 0:
            break
        state = now
        if now[0] <= ONE_TASK:
            links = links.coalesce(1)
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = links.select(F.explode(ends).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        links = keep(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
