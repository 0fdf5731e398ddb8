"""One-to-one matching of groups over two versions of a hierarchy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanloom.functions.vectors import unit
from spanloom.operators.clusters import BLOCK_ROWS
from spanloom.operators.density import DIGITS, pack
from spanloom.operators.groups import KEEP_DISTANCE, KEEP_JACCARD
from spanloom.session import written


def greedy_matching(edges: DataFrame) -> DataFrame:
    """The edges (``cur, prev, cost``) that a greedy pass by (cost, cur, prev) would take, each end at most once.

    In a round every end names its best edge; an edge that both its ends name is taken, as no better one can
    block it, and edges at taken ends go. The best edge of all is always taken, so rounds end; on sparse
    edges they are few. Nothing is sorted as a whole and no end gathers its edges.
    """
    left = written(edges.select("cur", "prev", "cost"), "matching")
    taken = None
    while not left.isEmpty():
        of_cur = left.groupBy("cur").agg(F.min(F.struct("cost", "prev")).alias("x")).select("cur", F.col("x.prev").alias("prev"))
        of_prev = left.groupBy("prev").agg(F.min(F.struct("cost", "cur")).alias("x")).select(F.col("x.cur").alias("cur"), "prev")
        both = written(left.join(of_cur, ["cur", "prev"], "left_semi").join(of_prev, ["cur", "prev"], "left_semi"), "matching")
        taken = both if taken is None else taken.unionByName(both)
        left = written(left.join(both.select("cur"), "cur", "left_anti").join(both.select("prev"), "prev", "left_anti"), "matching")
    return left if taken is None else taken


def overlaps(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``cur, prev, jaccard`` of all groups that share a session; members are (group_id, session_key)."""
    current, previous = (df.select("group_id", "session_key").distinct() for df in (current, previous))
    size = lambda df, name, out: df.groupBy(F.col("group_id").alias(name)).agg(F.count(F.lit(1)).alias(out))
    both = current.withColumnRenamed("group_id", "cur").join(previous.withColumnRenamed("group_id", "prev"), "session_key")
    common = both.groupBy("cur", "prev").agg(F.count(F.lit(1)).alias("i"))
    rated = common.join(size(current, "cur", "a"), "cur").join(size(previous, "prev", "b"), "prev")
    return rated.select("cur", "prev", (F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("jaccard"))


def close_medoids(current: DataFrame, previous: DataFrame, limit: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``cur, prev, distance`` of medoids (group_id, vector) whose cosine distance is ``limit`` at most; blocks meet, only such pairs are sent."""
    sides = []
    for df in (current, previous):
        units = df.select(F.col("group_id").alias("id"), unit(F.col("vector")).alias("u"))
        sides.append(pack(units, ["id", "u"], block_rows))
    left, right = sides
    met = left.select(F.col("id").alias("l_id"), F.col("u").alias("l_u")).hint("shuffle_replicate_nl").crossJoin(right.select("id", "u"))
    kinds = [df.schema["group_id"].dataType.simpleString() for df in (current, previous)]

    def near(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x, y = np.asarray(row.l_u, dtype=float).reshape(len(row.l_id), -1), np.asarray(row.u, dtype=float).reshape(len(row.id), -1)
                d = np.round(np.maximum(1 - x @ y.T, 0.0), DIGITS)
                out += [(row.l_id[i], row.id[j], d[i, j]) for i, j in np.argwhere(d <= limit)]
            yield pd.DataFrame(out, columns=["cur", "prev", "distance"])

    return met.mapInPandas(near, f"cur {kinds[0]}, prev {kinds[1]}, distance double")


def carried(current: DataFrame, previous: DataFrame, medoids: DataFrame, previous_medoids: DataFrame,
            least: float = KEEP_JACCARD, most: float = KEEP_DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``cur, prev, jaccard, distance``: which earlier group each current one continues, each at most once.

    First by overlap of ``least`` or more, greatest first; then, for groups that found none, by medoids
    no further apart than ``most``, nearest first; ties by ids. A pair of the second kind has its overlap, 0 if none.
    """
    shared = written(overlaps(current, previous), "overlaps")
    first = greedy_matching(shared.where(F.col("jaccard") >= least).select("cur", "prev", (-F.col("jaccard")).alias("cost")))
    rest = medoids.join(first.select(F.col("cur").alias("group_id")), "group_id", "left_anti")
    gone = previous_medoids.join(first.select(F.col("prev").alias("group_id")), "group_id", "left_anti")
    second = greedy_matching(close_medoids(rest, gone, most, block_rows).withColumnRenamed("distance", "cost"))
    pairs = first.select("cur", "prev", F.lit(None).cast("double").alias("distance")).unionByName(second.select("cur", "prev", F.col("cost").alias("distance")))
    return pairs.join(shared, ["cur", "prev"], "left").select("cur", "prev", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), "distance")


def delta(current: DataFrame, previous: DataFrame, medoids: DataFrame, previous_medoids: DataFrame, **kw) -> DataFrame:
    """``group_id, previous_id, action, distance``: keep (same sessions), update, add, and remove for earlier groups that nobody continues."""
    pairs = written(carried(current, previous, medoids, previous_medoids, **kw), "carried")
    cur = current.select(F.col("group_id").alias("cur")).distinct().join(pairs, "cur", "left")
    action = F.when(F.col("prev").isNull(), "add").when(F.col("jaccard") == 1.0, "keep").otherwise("update")
    gone = previous.select(F.col("group_id").alias("prev")).distinct().join(pairs, "prev", "left_anti")
    return cur.select(F.col("cur").alias("group_id"), F.coalesce("prev", F.lit("")).alias("previous_id"), action.alias("action"), "distance").unionByName(
        gone.select(F.lit("").alias("group_id"), F.col("prev").alias("previous_id"), F.lit("remove").alias("action"), F.lit(None).cast("double").alias("distance")))
