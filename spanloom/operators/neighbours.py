"""Nearest neighbours inside groups, and the local outlier factor over them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.functions.ordered import Sequence
from spanloom.operators.clusters import BLOCK_ROWS, blocks
from spanloom.session import cut_lineage, written


#: Distinct values of a group that a task holds at once.
PIECE = 8192


@dataclass(frozen=True)
class Neighbours:
    """The nearest others of the rows of groups.

    ``pairs`` has key, id, other, distance and rank. Where a group's vectors are numbers, ``line`` stands for the pairs: equal rows
    have neighbours at equal places, so there is one row a distinct value: key, ``pos`` among the values, ``v``, and arrays ``step``
    (how many values away; 0 is the value itself), ``d`` (how far) and ``n`` (how many neighbours there). ``points`` are the rows of the line.
    """

    pairs: DataFrame | None
    line: DataFrame | None = None
    points: DataFrame | None = None


def group_neighbours(points: DataFrame, key: str, k: int, block_rows: int = BLOCK_ROWS, piece: int = PIECE) -> Neighbours:
    """The ``k`` nearest other members of the group of every row, ties by id. ``points`` has key, id and vector.

    Groups of plain numbers go over their distinct values; groups of vectors, and those in which an id
    repeats or a value is no number, over pairs of blocks.
    """
    rows = written(points.select(key, "id", F.transform("vector", lambda x: x.cast("double")).alias("u")), "points")
    if rows.agg(F.max(F.size("u"))).first()[0] != 1:
        return Neighbours(_pairs(rows, points, key, k, block_rows))
    value = F.get("u", 0)
    plain = F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    # nothing is less than a value that is none, so such a group goes over pairs
    odd = rows.where(~plain | F.col("id").isNull()).select(key).unionByName(rows.groupBy(key, "id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key)).distinct()
    odd = cut_lineage(odd)
    pairs = None if odd.isEmpty() else _pairs(rows.join(odd, key, "left_semi"), points, key, k, block_rows)
    lined = rows.where(F.col(key).isNotNull()).join(odd, key, "left_anti").select(key, "id", value.alias("v"))
    return Neighbours(pairs, _line(lined, key, k, piece), lined)


def _pieces(values: DataFrame, key: str, reach: int, piece: int):
    """Values of a group by pieces, each with ``reach`` more values on both sides; ``home`` tells its own."""
    at = lambda shift: F.floor((F.col("pos") - 1 + shift) / piece)
    rows = values.withColumn("_home", at(0)).withColumn("_piece", F.explode(F.sequence(F.greatest(F.lit(0), at(-reach)), at(reach))))
    return rows.withColumn("home", F.col("_home") == F.col("_piece")).drop("_home").groupBy(key, "_piece")


def _outward(v: np.ndarray, ids: list, i: int, k: int) -> list[tuple[int, float, int]]:
    """(step, distance, count) of the k nearest others of a row of value ``v[i]``; only the least ids of a value are listed, which is enough."""
    found, need = [(0, 0.0, len(ids[i]) - 1)], k + 1 - len(ids[i])
    left, right, end = i - 1, i + 1, len(v)
    while need > 0 and (left >= 0 or right < end):
        d = min(v[i] - v[left] if left >= 0 else np.inf, v[right] - v[i] if right < end else np.inf)
        level = []
        while left >= 0 and v[i] - v[left] == d:
            level.append(left)
            left -= 1
        while right < end and v[right] - v[i] == d:
            level.append(right)
            right += 1
        there = sum(len(ids[j]) for j in level)
        if there <= need:
            found += [(j - i, d, len(ids[j])) for j in level]
        else:
            counts = Counter(j for _, j in sorted((x, j) for j in level for x in ids[j])[:need])
            found += [(j - i, d, n) for j, n in counts.items()]
        need -= there
    return [x for x in found if x[2]]


def _line(rows: DataFrame, key: str, k: int, piece: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    # of equal rows the k + 1 least ids can be neighbours of others
    order = Window.partitionBy(key, "v").orderBy("id")
    least = rows.withColumn("_nr", F.row_number().over(order)).where(F.col("_nr") <= k + 1)
    values = written(least.groupBy(key, "v").agg(F.collect_list("id").alias("ids")), "values")
    placed = Sequence(values, [key], ["v"]).number("pos").done()

    def nearest(keys, pdf):
        pdf = pdf.sort_values("pos")
        v, ids = pdf["v"].to_numpy(), pdf["ids"].tolist()
        out = []
        for i in np.flatnonzero(pdf["home"].to_numpy()):
            found = _outward(v, ids, i, k)
            if found:
                out.append((keys[0], pdf["pos"].iat[i], v[i], *map(list, zip(*found))))
        return pd.DataFrame(out, columns=[key, "pos", "v", "step", "d", "n"])

    shape = f"{key} {types[key]}, pos bigint, v double, step array<int>, d array<double>, n array<int>"
    return _pieces(placed, key, k, piece).applyInPandas(nearest, shape)


def _pairs(rows: DataFrame, points: DataFrame, key: str, k: int, block_rows: int) -> DataFrame:
    """(key, id, other, distance, rank): blocks of a group meet block by block, and a meeting passes on the
    k best of each row only; the best of all meetings are cut on the map side, too.
    """
    packed = blocks(rows, [key], block_rows)
    left = packed.select(key, F.col("ids").alias("l_ids"), F.col("flat").alias("l_flat"))
    # a meeting is a key of its own, so that a large group is spread over the cluster
    meetings = left.join(packed.select(key, "block", "ids", "flat"), key)

    def nearest(batches):
        for pdf in batches:
            out = []
            for group, l_ids, l_flat, _, ids, flat in pdf.itertuples(index=False):
                x, y = np.asarray(l_flat).reshape(len(l_ids), -1), np.asarray(flat).reshape(len(ids), -1)
                mine, theirs = np.asarray(l_ids, dtype=object), np.asarray(ids, dtype=object)
                for i, row in enumerate(x):
                    d = np.sqrt(((y - row) ** 2).sum(1))
                    d[theirs == mine[i]] = np.inf
                    best = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                    best = best[np.lexsort((theirs[best].astype(str), d[best]))][:k]
                    out += [(group, mine[i], theirs[j], d[j]) for j in best if np.isfinite(d[j])]
            yield pd.DataFrame(out, columns=[key, "id", "other", "distance"])

    types = {f.name: f.dataType.simpleString() for f in points.schema}
    found = meetings.mapInPandas(nearest, f"{key} {types[key]}, id {types['id']}, other {types['id']}, distance double")
    order = Window.partitionBy(key, "id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def local_outlier_factor(near: Neighbours, key: str, k: int, piece: int = PIECE) -> DataFrame:
    """(key, id, lof): mean density of the neighbours over the own one; about 1 inside a cluster."""
    of_pairs = None if near.pairs is None else _pair_factor(near.pairs, key)
    if near.line is None:
        return of_pairs
    types = {f.name: f.dataType.simpleString() for f in near.points.schema}

    def factor(keys, pdf):
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        size = pdf["step"].map(len).to_numpy()
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        own = np.repeat(np.arange(len(pdf)), size)
        d, n, step = (np.concatenate(pdf[c].tolist()) for c in ("d", "n", "step"))
        # by place: a value without neighbours is the only one of its group; what lies beyond the piece is not asked for
        other = np.clip(np.searchsorted(pdf["pos"].to_numpy(), pdf["pos"].to_numpy()[own] + step), 0, len(pdf) - 1)
        total = np.add.reduceat(n, start)
        reach = np.maximum.reduceat(d, start)
        density = 1 / (np.add.reduceat(n * np.maximum(d, reach[other]), start) / total + 1e-10)
        lof = np.add.reduceat(n * density[other], start) / total / density
        home = pdf["home"].to_numpy()
        return pd.DataFrame({key: keys[0], "v": pdf["v"].to_numpy()[home], "lof": lof[home]})

    of_value = _pieces(near.line, key, 2 * k, piece).applyInPandas(factor, f"{key} {types[key]}, v double, lof double")
    on_line = near.points.join(of_value, [key, "v"]).select(key, "id", "lof")
    return on_line if of_pairs is None else on_line.unionByName(of_pairs)


def _pair_factor(neighbours: DataFrame, key: str) -> DataFrame:
    reach = neighbours.groupBy(key, "id").agg(F.max("distance").alias("k_distance"))
    near = neighbours.join(reach.select(key, F.col("id").alias("other"), F.col("k_distance").alias("far")), [key, "other"])
    density = near.groupBy(key, "id").agg((1 / (F.avg(F.greatest("distance", "far")) + 1e-10)).alias("density"))
    around = neighbours.join(density.select(key, F.col("id").alias("other"), F.col("density").alias("theirs")), [key, "other"])
    return around.groupBy(key, "id").agg(F.avg("theirs").alias("theirs")).join(density, [key, "id"]).select(
        key, "id", (F.col("theirs") / F.col("density")).alias("lof"))
