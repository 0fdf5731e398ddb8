"""Analytics over the sessions of a group; the group is one more key, so all groups run at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.ordered import Sequence, quantiles
from spanloom.functions.vectors import by_dimension, cosine_distance, euclidean, mean_vector, norm, unit
from spanloom.operators.packed import Graphs, of_graphs, per_graph, xxhash64
from spanloom.session import cut_lineage

# Bootstrap size and confidence; width limits of the confidence indicator.
REPLICATES, DRAWS, CONFIDENCE = 2000, 10, 95.0
HIGH_WIDTH, MEDIUM_WIDTH = 0.05, 0.15
# When an old group keeps its id.
KEEP_JACCARD, KEEP_DISTANCE = 0.8, 0.2


# -- group identity -------------------------------------------------------------------------


def medoids(vectors: DataFrame, key: str = "group_id", metric: str = "cosine") -> DataFrame:
    """Member nearest to the mean vector of its group; ties by id."""
    centre = mean_vector(vectors, [key], "vector")
    measure = cosine_distance if metric == "cosine" else euclidean
    near = vectors.join(centre, key).withColumn("d", measure(F.col("vector"), F.col("centroid")))
    return near.groupBy(key).agg(F.min(F.struct("d", "session_key")).alias("m"), F.count(F.lit(1)).alias("n_sessions")).select(
        key, F.col("m.session_key").alias("medoid"), F.col("m.d").alias("distance"), "n_sessions")


def content_hashes(members: DataFrame, key: str = "group_id", item: str = "session_key") -> DataFrame:
    """sha256 over the sorted distinct non-empty session ids of a group, joined by commas.

    The digest is sequential, so sorted ids stream through it; nothing is gathered.
    """
    rows = members.where(F.coalesce(item, F.lit("")) != "").select(key, item).distinct()
    ordered = rows.repartition(key).sortWithinPartitions(key, item)

    def scan(batches):
        current, state = None, None
        for pdf in batches:
            done = []
            for k, v in zip(pdf[key], pdf[item]):
                if k != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = k, hashlib.sha256(v.encode())
                else:
                    state.update(b"," + v.encode())
            yield pd.DataFrame(done, columns=[key, "hash"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=[key, "hash"])

    return ordered.mapInPandas(scan, f"{key} string, hash string")


def collapsed(members_below: DataFrame, nodes: DataFrame) -> DataFrame:
    """Make the given branch nodes leaves that hold every session of their subtree."""
    return members_below.join(nodes.select("group_id"), "group_id", "left_semi").select("group_id", "session_key").distinct()


def carried_ids(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Best previous group of each current one by Jaccard overlap, when the choice is mutual.

    Overlaps are counted by joining on the session, so only groups that share one are compared.
    """
    size = lambda df, out: df.groupBy("group_id").agg(F.count(F.lit(1)).alias(out))
    both = current.select(F.col("group_id").alias("cur"), "session_key").join(
        previous.select(F.col("group_id").alias("prev"), "session_key"), "session_key")
    common = both.groupBy("cur", "prev").agg(F.count(F.lit(1)).alias("i"))
    rated = (
        common.join(size(current, "a").withColumnRenamed("group_id", "cur"), "cur")
        .join(size(previous, "b").withColumnRenamed("group_id", "prev"), "prev")
        .withColumn("jaccard", F.col("i") / (F.col("a") + F.col("b") - F.col("i"))))
    of_cur = rated.groupBy("cur").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "prev")).alias("x")).select("cur", F.col("x.prev").alias("prev"))
    of_prev = rated.groupBy("prev").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "cur")).alias("x")).select(F.col("x.cur").alias("cur"), "prev")
    mutual = of_cur.join(of_prev, ["cur", "prev"], "left_semi")
    return rated.join(mutual, ["cur", "prev"], "left_semi").where(F.col("jaccard") >= KEEP_JACCARD).select("cur", "prev", "jaccard")


def group_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """add, update, keep and remove, as rows (group_id, previous_id, action)."""
    kept = carried_ids(current, previous)
    cur = current.select(F.col("group_id").alias("cur")).distinct().join(kept, "cur", "left")
    action = F.when(F.col("prev").isNull(), "add").when(F.col("jaccard") == 1.0, "keep").otherwise("update")
    gone = previous.select(F.col("group_id").alias("prev")).distinct().join(kept, "prev", "left_anti")
    return cur.select(F.col("cur").alias("group_id"), F.coalesce("prev", F.lit("")).alias("previous_id"), action.alias("action")).unionByName(
        gone.select(F.lit("").alias("group_id"), F.col("prev").alias("previous_id"), F.lit("remove").alias("action")))


def single_query_names(queries: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups whose queries are all the same text take it as their name."""
    return queries.groupBy(key).agg(F.min("query").alias("name"), F.max("query").alias("_x")).where(
        F.col("name") == F.col("_x")).drop("_x")


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(texts with a known vector, distinct texts still to encode)."""
    known = cache.where(F.col("model") == model).select("text", "vector")
    hits = texts.join(known, "text", "left")
    return hits.where("vector IS NOT NULL"), hits.where("vector IS NULL").select("text").distinct()


# -- consistency ----------------------------------------------------------------------------


def as_consistency(df: DataFrame, mean: Column, low: Column, high: Column, top: Column) -> DataFrame:
    """Turn a spread into a consistency: (max - value) / max, and rate how sure it is."""
    width = (high - low) / top
    sure = F.when(width < HIGH_WIDTH, "High").when(width < MEDIUM_WIDTH, "Medium").otherwise("Low")
    return df.withColumns({
        "consistency": (top - mean) / top, "ci_low": (top - high) / top, "ci_high": (top - low) / top, "indicator": sure})


def metric_spread(values: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation, normalised by the range (1 where the range is 0)."""
    agg = values.groupBy(*keys).agg(F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("r"), F.count("value").alias("n"))
    top = F.when(F.col("r") == 0, 1.0).otherwise(F.col("r"))
    return agg.select(*keys, "n", "std", top.alias("max_score"), ((top - F.col("std")) / top).alias("consistency"))


def bootstrap_consistency(values: DataFrame, keys: list[str], replicates: int = REPLICATES, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Mean and interval of the deviation over resamples with replacement.

    Draw d takes the row whose number is the first eight digits of md5(seed|d) mod n, so the result is
    repeatable anywhere. What is joined is replicates * draws rows per group, whatever its size.
    """
    numbered = Sequence(values, keys, ["value", "id"]).number("row").done().withColumn("row", F.col("row") - 1)
    stats = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("r"))
    plan = stats.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates * draws - 1))).alias("d"))
    picks = plan.select(*keys, F.floor(F.col("d") / draws).alias("replicate"), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "d")), 1, 8), 16, 10).cast("long") % F.col("n")).alias("row"))
    per = picks.join(numbered.select(*keys, "row", "value"), [*keys, "row"]).groupBy(*keys, "replicate").agg(F.stddev_pop("value").alias("s"))
    edge = (100 - CONFIDENCE) / 200
    summary = per.groupBy(*keys).agg(F.avg("s").alias("m"), F.percentile("s", F.array(F.lit(edge), F.lit(1 - edge))).alias("q"))
    joined = summary.join(stats, keys)
    top = F.when(F.col("r") == 0, 1.0).otherwise(F.col("r"))
    out = as_consistency(joined, F.col("m"), F.col("q")[0], F.col("q")[1], top)
    return out.select(*keys, "n", "consistency", "ci_low", "ci_high", "indicator")


def text_dispersion(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """1 - length of the mean unit vector; 0 when all vectors are zero."""
    rows = vectors.select(*keys, unit(F.col("vector")).alias("u"), (norm(F.col("vector")) > 0).alias("_real"))
    real = rows.groupBy(*keys).agg(F.bool_or("_real").alias("any"))
    centre = mean_vector(rows, keys, "u")
    r = F.least(F.lit(1.0), norm(F.col("centroid")))
    return centre.join(real, keys).select(*keys, F.when(F.col("any"), 1 - r).otherwise(0.0).alias("dispersion"))


def semantic_entropy(classes: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Entropy of class shares; members without a class count as classes of their own."""
    own = F.coalesce(F.col(cls).cast("string"), F.concat(F.lit("own:"), F.col("session_key").cast("string")))
    counts = classes.groupBy(*keys, own.alias("_c")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    return total.select(*keys, (F.log("n") - F.col("s") / F.col("n")).alias("entropy"))


def wl_labels(nodes: DataFrame, edges: DataFrame, keys: list[str], rounds: int = 4) -> DataFrame:
    """Label counts ``c`` of all refinement rounds per graph, with the ``length`` of its vector of counts.

    A label is a 64-bit hash of a node's label and those of its successors in the round before, in ascending order.
    Plain graphs go through all rounds in one pass (``packed``), the others by a join a round.
    """
    from functools import reduce

    def refine(found: Graphs):
        label = pc.fill_null(found.value, 0).to_numpy(zero_copy_only=False)
        known = found.value.is_valid().to_numpy(zero_copy_only=False)
        near = (found.next >= 0) & known[found.next] if len(label) else known
        every = [label]
        for _ in range(rounds):
            own = xxhash64(label, np.full(len(label), 42))
            label = np.where(near, xxhash64(label[found.next], own), own) if len(label) else label
            every.append(label)
        graph, label, known = np.tile(found.graph, rounds + 1), np.concatenate(every), np.tile(known, rounds + 1)
        label = np.where(known, label, 0)
        order = np.lexsort((label, known, graph))
        graph, label, known = graph[order], label[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(graph) != 0) | (np.diff(known) != 0) | (label[1:] != label[:-1])])) if len(graph) else np.zeros(0, int)
        c = np.diff(first, append=len(graph))
        own = graph[first]
        length = np.sqrt(np.bincount(own, weights=c.astype(float) ** 2)) if len(own) else np.zeros(0)
        return own, {"label": pa.array(label[first], mask=~known[first]), "c": pa.array(c), "length": pa.array(length[own] if len(own) else length)}

    start = F.when(F.col("agent").isNotNull(), F.xxhash64("agent"))
    done, odd = per_graph(nodes, edges, keys, start, refine, "label bigint, c bigint, length double", "labels")
    if odd is None:
        return done
    nodes, edges = of_graphs(nodes, odd, keys), of_graphs(edges, odd, keys)
    labels = nodes.select(*keys, "node", start.alias("label"))
    rounds_ = [labels]
    for _ in range(rounds):
        near = edges.select(*keys, F.col("src").alias("_src"), F.col("dst").alias("node")).join(labels, [*keys, "node"]).groupBy(
            *keys, F.col("_src").alias("node")).agg(F.array_sort(F.collect_list("label")).alias("near"))
        labels = cut_lineage(labels.join(near, [*keys, "node"], "left").select(
            *keys, "node", F.when(F.col("label").isNotNull(), F.xxhash64("label", "near")).alias("label")))
        rounds_.append(labels)
    counts = cut_lineage(reduce(DataFrame.unionByName, rounds_).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("c")))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    length = counts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    return done.unionByName(counts.join(length, same).select(*done.columns))


def mean_graph_distance(labels: DataFrame, graphs: DataFrame, group: list[str], graph: str) -> DataFrame:
    """Mean of 1 - cosine over all pairs of graphs, from sums only.

    With unit vectors u, the cosines of all pairs add up to (|sum u|^2 - number of them) / 2.
    """
    filled = labels.select(*group, graph).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    if "length" not in labels.columns:
        length = labels.groupBy(*group, graph).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
        labels = labels.join(length, [*group, graph])
    named = labels.where(F.col(graph).isNotNull())
    sums = named.groupBy(*group, "label").agg(F.sum(F.col("c") / F.col("length")).alias("s"))
    square = sums.groupBy(*group).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    sizes = graphs.select(*group, graph).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.join(square, group, "left").join(filled, group, "left").na.fill(0)
    pairs = F.col("n") * (F.col("n") - 1)
    return out.select(*group, "n", F.when(F.col("n") > 1, 1 - (F.col("sq") - F.col("m")) / pairs).otherwise(0.0).alias("distance"))


# -- outliers -------------------------------------------------------------------------------


def finite(values: DataFrame, column: str = "value") -> DataFrame:
    v = F.col(column)
    return values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def robust_outliers(values: DataFrame, keys: list[str], limit: float = 3.5) -> DataFrame:
    """Modified z-score above the limit. Fewer than two or only equal values have no outliers.

    Where more than half the values are equal, the mean deviation stands in for the median one.
    """
    rows = finite(values)
    mid = quantiles(rows, keys, "value", {"median": 0.5})
    dev = rows.join(mid, keys).withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = quantiles(dev.select(*keys, "dev"), keys, "dev", {"mad": 0.5}).drop("n")
    mean_dev = dev.groupBy(*keys).agg(F.avg("dev").alias("mean_dev"))
    scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.col("mean_dev") * 1.253314)
    out = dev.join(mad, keys).join(mean_dev, keys)
    z = F.when(scale > 0, (F.col("value") - F.col("median")) / scale).otherwise(0.0)
    return out.withColumn("z", z).withColumn("outlier", (F.col("n") >= 2) & (F.abs(F.col("z")) > limit)).drop("dev", "mad", "mean_dev")


def fence_outliers(values: DataFrame, keys: list[str], k: float = 1.5) -> DataFrame:
    """Outside the quartiles by more than k interquartile ranges."""
    rows = finite(values)
    q = quantiles(rows, keys, "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    out = (F.col("value") < F.col("q1") - k * iqr) | (F.col("value") > F.col("q3") + k * iqr)
    return rows.join(q, keys).withColumn("outlier", (F.col("n") >= 2) & out)


TREES, TREE_ROWS, ANOMALY_SCORE = 100, 256, 0.5


def _c(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n keys."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_cuts(values: np.ndarray, rng: np.random.Generator) -> list[tuple[float, float]]:
    """One isolation tree over numbers, flattened: (from this value on, path length)."""
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    out, stack = [], [(-np.inf, np.sort(values), 0)]
    while stack:
        lo, part, depth = stack.pop()
        if depth >= limit or len(part) < 2 or part[0] == part[-1]:
            out.append((lo, depth + _c(len(part))))
            continue
        cut = rng.uniform(part[0], part[-1])
        at = np.searchsorted(part, cut, side="left")
        at = min(max(at, 1), len(part) - 1)
        stack.append((lo, part[:at], depth + 1))
        stack.append((float(cut), part[at:], depth + 1))
    return out


def isolation_outliers(values: DataFrame, keys: list[str], seed: int = 11, trees: int = TREES) -> DataFrame:
    """Isolation forest over one number per session.

    Every tree sees at most 256 rows, picked by hash. In one dimension a tree is a step function of
    the value, so the forest is their sum; rows find their step by carrying the last breakpoint
    forward in one ordered pass.
    """
    rows = finite(values).select(*keys, "id", "value")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    usable = rows.join(size.where("n >= 2 AND lo < hi"), keys)
    share = F.least(F.lit(1.0), F.lit(2.0 * TREE_ROWS) / F.col("n"))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "id"), F.lit(1_000_000_007))
    hit = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share * 1_000_000_007)
    sampled = usable.select(*keys, "id", "value", F.explode(hit).alias("tree")).withColumn("h", draw(F.col("tree")))
    w = Window.partitionBy(*keys, "tree").orderBy("h", "id")
    sampled = sampled.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TREE_ROWS)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def grow(pdf):
        rng = np.random.default_rng(seed + int(pdf["tree"].iloc[0]))
        steps = isolation_cuts(pdf["value"].to_numpy(dtype=float), rng)
        steps.sort()
        prev, out = 0.0, []
        for at, length in steps:
            out.append((max(at, -1.0e308), length - prev))
            prev = length
        made = pd.DataFrame(out, columns=["value", "delta"])
        for k in keys:
            made[k] = pdf[k].iloc[0]
        made["norm"] = _c(len(pdf))
        return made[[*keys, "value", "delta", "norm"]]

    steps = sampled.groupBy(*keys, "tree").applyInPandas(grow, f"{shape}, value double, delta double, norm double")
    merged = steps.groupBy(*keys, "value").agg(F.sum("delta").alias("delta"))
    scale = steps.groupBy(*keys).agg(F.avg("norm").alias("norm"))
    none = F.lit(None)
    line = merged.select(*keys, "value", F.lit(0).alias("side"), "delta", none.cast(types["id"]).alias("id")).unionByName(
        usable.select(*keys, "value", F.lit(1).alias("side"), F.lit(0.0).alias("delta"), "id"))
    paths = Sequence(line, keys, ["value", "side", "id"]).running_sum("length", "delta").done().where("side = 1").join(scale, keys)
    score = F.pow(F.lit(2.0), -(F.col("length") / trees) / F.nullif(F.col("norm"), F.lit(0.0)))
    scored = paths.select(*keys, "id", score.alias("score"))
    return rows.join(scored, [*keys, "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn(
        "outlier", F.col("score") > ANOMALY_SCORE)


def centroid_outliers(vectors: DataFrame, key: str = "group_id", limit: float = 3.5) -> DataFrame:
    """Members unusually far from the mean vector of their group."""
    far = vectors.join(mean_vector(vectors, [key], "vector"), key).select(
        key, "session_key", euclidean(F.col("vector"), F.col("centroid")).alias("value"))
    return robust_outliers(far, [key], limit)


def path_tokens(nodes: DataFrame, edges: DataFrame, keys: list[str], max_length: int = 10) -> DataFrame:
    """Counts of agent paths up to a length per graph: all walks along edges, extended one hop a time.

    Plain graphs get all lengths in one pass (``packed``). For the others each length is written before it is extended, so none is
    worked out twice.
    """
    from functools import reduce

    def extend(found: Graphs):
        token, at = found.value, np.arange(len(found.value))
        tokens, graphs = [token], [found.graph]
        for _ in range(max_length - 1):
            on = np.flatnonzero(found.next[at] >= 0)
            if not len(on):
                break
            at = found.next[at[on]]
            token = pc.binary_join_element_wise(token.take(pa.array(on)), found.value.take(pa.array(at)), "__")
            tokens.append(token)
            graphs.append(found.graph[at])
        coded = pa.concat_arrays(tokens).dictionary_encode()
        kinds = len(coded.dictionary) + 1
        pair, c = np.unique(np.concatenate(graphs) * kinds + pc.fill_null(coded.indices, kinds - 1).to_numpy(zero_copy_only=False), return_counts=True)
        code = pair % kinds
        return pair // kinds, {"token": coded.dictionary.take(pa.array(code, mask=code == kinds - 1)), "c": pa.array(c)}

    done, odd = per_graph(nodes, edges, keys, F.replace("agent", F.lit(" "), F.lit("_")), extend, "token string, c bigint", "tokens")
    if odd is None:
        return done
    nodes, edges = of_graphs(nodes, odd, keys), of_graphs(edges, odd, keys)
    named = nodes.select(*keys, "node", F.replace("agent", F.lit(" "), F.lit("_")).alias("agent"))
    paths = named.select(*keys, F.col("node").alias("at"), F.col("agent").alias("token"), F.lit(1).cast("bigint").alias("c"))
    out = [paths]
    step = edges.select(*keys, F.col("src").alias("at"), F.col("dst").alias("node")).join(named, [*keys, "node"])
    for _ in range(max_length - 1):
        # Walks that end in the same node with the same token are counted, not listed.
        paths = paths.join(step, [*keys, "at"]).groupBy(*keys, F.col("node").alias("at"), F.concat("token", F.lit("__"), "agent").alias("token")).agg(
            F.sum("c").alias("c"))
        paths = cut_lineage(paths)
        out.append(paths)
    return done.unionByName(reduce(DataFrame.unionByName, out).groupBy(*keys, "token").agg(F.sum("c").alias("c")))


def token_distance(tokens: DataFrame, graphs: DataFrame, group: list[str], graph: str) -> DataFrame:
    """Distance of a graph's token counts from the group's mean counts, from three sums."""
    n = graphs.select(*group, graph).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    mean = tokens.groupBy(*group, "token").agg(F.sum("c").alias("t")).join(n, group).select(*group, "token", (F.col("t") / F.col("n")).alias("m"))
    mm = mean.groupBy(*group).agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    own = tokens.join(mean, [*group, "token"]).groupBy(*group, graph).agg(
        F.sum(F.col("c") * F.col("c") - 2 * F.col("c") * F.col("m")).alias("x"))
    full = graphs.select(*group, graph).distinct().join(own, [*group, graph], "left").join(mm, group, "left").na.fill(0.0)
    return full.select(*group, graph, F.sqrt(F.greatest(F.lit(0.0), F.col("x") + F.col("mm"))).alias("value"))


# -- normal behaviour -----------------------------------------------------------------------


def normal_ranges(values: DataFrame, keys: list[str], k: float = 2.0, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """Three ranges at once: mean +- k std, quantiles with the median, mean +- std with the variance."""
    rows = finite(values)
    g = rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("var"))
    q = quantiles(rows, keys, "value", {"q_lower": lower, "median": 0.5, "q_upper": upper})
    m, s = F.col("mean"), F.col("std")
    return g.join(q, keys).withColumns({"g_lower": m - k * s, "g_upper": m + k * s, "v_lower": m - s, "v_upper": m + s})


def vector_ranges(vectors: DataFrame, keys: list[str], k: float = 2.0) -> DataFrame:
    """The same per dimension, one row per dimension."""
    return normal_ranges(by_dimension(vectors, keys, "vector").withColumnRenamed("x", "value"), [*keys, "dim"], k)


def covariance(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Sample covariance for pairs of dimensions i <= j, one row each.

    A row contributes its dims * (dims + 1) / 2 products, which are summed before the shuffle.
    """
    v = F.transform("vector", lambda x: x.cast("double"))
    pair = F.flatten(F.transform(v, lambda x, i: F.transform(v, lambda y, j: F.struct(i.alias("i"), j.alias("j"), x.alias("x"), y.alias("y")))))
    rows = vectors.select(*keys, F.inline(F.filter(pair, lambda p: p["i"] <= p["j"])))
    return rows.groupBy(*keys, "i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def chi2_quantile_95(dims: Column) -> Column:
    """95 % quantile of chi square by the Wilson-Hilferty formula (error below 0.3 % from 2 dimensions on)."""
    a = F.lit(2.0) / (F.lit(9.0) * dims)
    return dims * F.pow(1 - a + F.lit(1.6448536269514722) * F.sqrt(a), F.lit(3.0))


def confidence_ellipsoid(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, covariance rows and the threshold of the squared Mahalanobis distance."""
    dims = vectors.groupBy(*keys).agg(F.max(F.size("vector")).alias("dims"))
    return covariance(vectors, keys).join(dims.withColumn("threshold", chi2_quantile_95(F.col("dims"))), keys)


def medoid_graphs(edges: DataFrame, graphs: DataFrame, group: list[str], graph: str) -> DataFrame:
    """Graph with the least sum of edge-set differences to all others.

    Sum over others of |A| + |B| - 2 |A n B| = n |A| + sum |B| - 2 sum over A's edges of their count.
    """
    e = edges.select(*group, graph, "src", "dst").distinct()
    counts = e.groupBy(*group, "src", "dst").agg(F.count(F.lit(1)).alias("c"))
    n = graphs.select(*group, graph).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    total = e.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    own = e.join(counts, [*group, "src", "dst"]).groupBy(*group, graph).agg(F.count(F.lit(1)).alias("a"), F.sum("c").alias("s"))
    rows = graphs.select(*group, graph).distinct().join(own, [*group, graph], "left").na.fill(0).join(n, group).join(total, group, "left").na.fill(0)
    rows = rows.withColumn("distance", F.col("n") * F.col("a") + F.col("total") - 2 * F.col("s"))
    return rows.groupBy(*group).agg(F.min(F.struct("distance", graph)).alias("m")).select(
        *group, F.col(f"m.{graph}").alias("medoid"), F.col("m.distance").alias("distance"))


def consensus_edges(edges: DataFrame, graphs: DataFrame, group: list[str], graph: str, share: float = 0.5) -> DataFrame:
    """Edges found in more than the share of a group's graphs."""
    n = graphs.select(*group, graph).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    counts = edges.select(*group, graph, "src", "dst").distinct().groupBy(*group, "src", "dst").agg(F.count(F.lit(1)).alias("c"))
    return counts.join(n, group).where(F.col("c") > F.col("n") * share).select(*group, "src", "dst", "c", "n")


def closest_to_consensus(edges: DataFrame, graphs: DataFrame, consensus: DataFrame, group: list[str], graph: str) -> DataFrame:
    e = edges.select(*group, graph, "src", "dst").distinct()
    size = consensus.groupBy(*group).agg(F.count(F.lit(1)).alias("k"))
    hit = e.join(consensus.select(*group, "src", "dst", F.lit(1).alias("hit")), [*group, "src", "dst"], "left")
    own = hit.groupBy(*group, graph).agg(F.count(F.lit(1)).alias("a"), F.count("hit").alias("h"))
    rows = graphs.select(*group, graph).distinct().join(own, [*group, graph], "left").join(size, group, "left").na.fill(0)
    d = F.col("a") + F.col("k") - 2 * F.col("h")
    return rows.groupBy(*group).agg(F.min(F.struct(d.alias("distance"), F.col(graph).alias("closest"))).alias("m")).select(*group, "m.closest", "m.distance")
