"""Bootstrap of text and graph consistency: replicate weights on sums of unit vectors, without pairs or copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.ordered import Sequence
from spanloom.functions.vectors import unit
from spanloom.operators.groups import CONFIDENCE, DRAWS, REPLICATES, as_consistency
from spanloom.session import written


#: Drawn members that are broadcast.
BROADCAST_ROWS = 250_000


def hashed(text: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 of a text as a number."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def weights(members: DataFrame, keys: list[str], item: str, replicates: int = REPLICATES, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """``keys, item, replicate, weight``: how often each replicate of ``draws`` rows with replacement has a member.

    Members are numbered by the hash of their id, then by it; draw d takes number md5(seed|d) mod n. A group
    has replicates * draws weights at most, however many members it has; those never drawn have none.
    """
    rows = members.select(*keys, item).distinct().withColumn("_h", hashed(F.col(item)))
    numbered = Sequence(rows, keys, ["_h", item]).number("_row").done().withColumn("_row", F.col("_row") - 1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    plan = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates * draws - 1))).alias("_d"))
    drawn = plan.select(*keys, F.floor(F.col("_d") / draws).alias("replicate"), (hashed(F.concat_ws("|", F.lit(str(seed)), "_d")) % F.col("_n")).alias("_row"))
    counted = drawn.groupBy(*keys, "_row", "replicate").agg(F.count(F.lit(1)).alias("weight"))
    return numbered.join(counted, [*keys, "_row"]).select(*keys, item, "replicate", "weight")


def squared_sums(parts: DataFrame, drawn: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, replicate, sq``: the squared length of the weighted sum of the members' vectors.

    ``parts`` has keys, item, ``feature`` and ``value``, one row per feature that is not 0. What meets is the drawn members only, and
    sums combine before they move.
    """
    total = parts.join(drawn, [*keys, item]).groupBy(*keys, "replicate", "feature").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    found = total.groupBy(*keys, "replicate").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    every = drawn.select(*keys, "replicate").distinct()
    return every.join(found, [*keys, "replicate"], "left").na.fill(0.0, ["sq"])


def _summary(per: DataFrame, keys: list[str], statistic: Column) -> DataFrame:
    """Mean and percentile interval over the replicates as a consistency of at most 1."""
    edge = (100 - CONFIDENCE) / 200
    q = per.select(*keys, statistic.alias("_s")).groupBy(*keys).agg(
        F.avg("_s").alias("_m"), F.percentile("_s", F.array(F.lit(edge), F.lit(1 - edge))).alias("_q"))
    return as_consistency(q, F.col("_m"), F.col("_q")[0], F.col("_q")[1], F.lit(1.0)).select(*keys, "consistency", "ci_low", "ci_high", "indicator")


def text_consistency(vectors: DataFrame, keys: list[str], item: str, replicates: int = REPLICATES, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Consistency of embedded texts: 1 less their dispersion, which is 1 less the length of the mean unit vector.

    ``vectors`` has keys, item and vector. A vector without length counts as one that points nowhere.
    """
    drawn = written(weights(vectors, keys, item, replicates, draws, seed), "drawn")
    parts = vectors.select(*keys, item, F.posexplode(unit(F.col("vector"))).alias("feature", "value")).where("value <> 0")
    length = F.least(F.lit(1.0), F.sqrt("sq") / draws)
    return _summary(squared_sums(parts, drawn, keys, item), keys, 1 - length)


def graph_consistency(labels: DataFrame, graphs: DataFrame, keys: list[str], item: str, replicates: int = REPLICATES, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Consistency of graphs: 1 less the mean distance, 1 - cosine of label counts, of the pairs of a replicate.

    ``labels`` has keys, item, ``label`` and count ``c``; ``graphs`` names every graph, so that one without labels is as far from
    others as can be. A graph drawn twice is a pair of distance 0 unless it has no labels.
    """
    drawn = written(weights(graphs, keys, item, replicates, draws, seed), "drawn")
    # a group has replicates * draws drawn members at most, however large it is; only theirs go on
    members = drawn.select(*keys, item).distinct()
    members = F.broadcast(members) if drawn.count() <= BROADCAST_ROWS else members
    labels = written(labels.join(members, [*keys, item], "left_semi"), "drawn_labels")
    length = labels.groupBy(*keys, item).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_len"))
    parts = labels.join(length, [*keys, item]).select(*keys, item, F.col("label").alias("feature"), (F.col("c") / F.col("_len")).alias("value"))
    real = drawn.join(length, [*keys, item]).groupBy(*keys, "replicate").agg(F.sum("weight").alias("_m"))
    per = squared_sums(parts, drawn, keys, item).join(real, [*keys, "replicate"], "left").na.fill(0, ["_m"])
    pairs = draws * (draws - 1)
    return _summary(per, keys, 1 - (F.col("sq") - F.col("_m")) / pairs if pairs else F.lit(0.0))
