"""Groups of things that are linked, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.session import cut


def groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; the root is the least node of its group and comes with itself.

    Each round hangs all neighbours of a node below the least of them, first the greater ones, then the others, until
    nothing moves (Kiveris et al., large and small stars). No group is gathered anywhere, and the rounds grow with the
    logarithm of the longest chain.
    """
    start = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null"))
    pairs = cut(start.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct())
    seen = None
    while True:
        sign = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        around = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        top = around.groupBy("hi").agg(F.min("lo").alias("least")).select(F.col("hi").alias("node"), F.least("hi", "least").alias("least"))
        large = around.filter("lo > hi").join(top, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(low, "hi").select(F.explode(F.when(F.col("lo") == F.col("least"), F.array(F.struct("hi", F.col("least").alias("lo")))).otherwise(
            F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))))).select("col.*")
        pairs = cut(small.distinct())
    below = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    alone = start.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(below, "node", "left_anti")
    return below.unionByName(alone.select("node", F.col("node").alias("root")))
