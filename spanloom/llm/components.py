"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import written


def connected(links: DataFrame) -> DataFrame:
    """``v, root`` for every end of ``links`` (``a, b`` long): root is the smallest end reachable.

    Rounds of: every vertex takes the least root among its own and its neighbours', passes it to the
    vertex that was its root, and then jumps to its root's root. Vertices are spread by themselves; a
    vertex with many links costs a partial minimum. Each round is written, so lineage stays short.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    state = both.select(F.col("a").alias("v")).distinct().withColumn("root", F.col("v"))
    state = written(state, "roots")
    while True:
        near = (both.join(state.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("root").alias("least"))
                .join(state.withColumnRenamed("v", "a"), "a").select("a", "root", F.least("root", "least").alias("least")))
        told = near.select(F.col("a").alias("v"), "least").unionByName(near.select(F.col("root").alias("v"), "least"))
        hooked = told.groupBy("v").agg(F.min("least").alias("root"))
        jumped = hooked.join(hooked.select(F.col("v").alias("root"), F.col("root").alias("over")), "root", "left").select(
            "v", F.least("root", F.coalesce("over", "root")).alias("root"))
        after = written(jumped, "roots")
        if after.join(state.withColumnRenamed("root", "was"), "v").where("root <> was").isEmpty():
            return after
        state = after
