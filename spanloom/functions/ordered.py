"""Ordered work inside groups that may be very long.

A window partitioned by a session alone puts a whole session into one task. ``Sequence`` first
counts rows per group. When no group is long, plain windows do. Otherwise groups of more than
``MIN_LONG_ROWS`` rows are cut into ordered chunks at quantiles of the first order column; windows
then run per (group, chunk), and what crosses a chunk border travels through a summary of one row
per chunk, which Spark broadcasts while it is small and joins when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.session import cut_lineage

CUTS = 199
MIN_LONG_ROWS = 1_000_000


def long_group_cuts(
    df: DataFrame, keys: list[str], first: str, min_rows: int = MIN_LONG_ROWS
) -> DataFrame | None:
    """(keys, _cuts) for every group of more than ``min_rows`` rows; None when there are none.

    Nothing here is broadcast by force: Spark does so while the cuts are few, and splits skewed joins when not.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    if counts.isEmpty():
        return None
    hot = counts.select(*keys)
    fractions = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    return (
        df.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(first, fractions, F.lit(10_000)).alias("_cuts"))
    )


def _sum_before(part: Column, w) -> Column:
    return F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, -1))


def _last_before(part: Column, w) -> Column:
    return F.last(part, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


class Sequence:
    """Rows of ``df`` ordered by ``order`` within ``keys``; the first order column is numeric or time."""

    def __init__(
        self,
        df: DataFrame,
        keys: Seq[str],
        order: Seq[str],
        probe: DataFrame | None = None,
        min_rows: int | None = None,
    ):
        self.keys, self.order = list(keys), list(order)
        source = df if probe is None else probe
        cuts = long_group_cuts(
            source.select(*self.keys, self.order[0]),
            self.keys,
            self.order[0],
            MIN_LONG_ROWS if min_rows is None else min_rows,
        )
        self.cut = cuts is not None
        self.df = df
        if self.cut:
            first = F.col(self.order[0])
            self.df = (
                df.join(cut_lineage(cuts), self.keys, "left")
                .withColumn("_chunk", F.coalesce(F.size(F.filter("_cuts", lambda c: c < first)), F.lit(0)))
                .withColumn("_long", F.col("_cuts").isNotNull())
                .drop("_cuts")
            )

    def _window(self, reverse: bool = False):
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, *(["_chunk"] if self.cut else [])).orderBy(*cols)

    def _carried(self, df: DataFrame, aggregate: Column, over, reverse: bool = False) -> DataFrame:
        """``df`` with ``_carry``: what the chunks before (after) a row's own hand over to it."""
        summary = self.df.where("_long").groupBy(*self.keys, "_chunk").agg(aggregate.alias("_part"))
        order = F.col("_chunk").desc() if reverse else F.col("_chunk").asc()
        w = Window.partitionBy(*self.keys).orderBy(order)
        carry = summary.select(*self.keys, "_chunk", over(F.col("_part"), w).alias("_carry"))
        return df.join(carry, [*self.keys, "_chunk"], "left")

    def _neighbour(self, cols: dict[str, Column | str], reverse: bool) -> "Sequence":
        pack = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(o) for o, c in cols.items()])
        near = F.lag(pack).over(self._window(reverse))
        if self.cut:
            edge = F.min_by if reverse else F.max_by
            df = self._carried(
                self.df.withColumn("_near", near),
                edge(pack, F.struct(*self.order)),
                lambda part, w: F.lag(part).over(w),
                reverse,
            ).withColumn("_near", F.coalesce("_near", "_carry")).drop("_carry")
        else:
            df = self.df.withColumn("_near", near)
        self.df = df.withColumns({o: F.col("_near")[o] for o in cols}).drop("_near")
        return self

    def prev(self, **cols: Column | str) -> "Sequence":
        """Values of the row before."""
        return self._neighbour(cols, reverse=False)

    def next(self, **cols: Column | str) -> "Sequence":
        """Values of the row after."""
        return self._neighbour(cols, reverse=True)

    def number(self, out: str = "pos", reverse: bool = False) -> "Sequence":
        """1-based position from the start (or from the end)."""
        df = self.df.withColumn(out, F.row_number().over(self._window(reverse)).cast("bigint"))
        if self.cut:
            df = self._carried(df, F.count(F.lit(1)), _sum_before, reverse)
            df = df.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        self.df = df
        return self

    def running_sum(self, out: str, col: Column | str, inclusive: bool = True) -> "Sequence":
        value = F.col(col) if isinstance(col, str) else col
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = self.df.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)))
        if self.cut:
            df = self._carried(df, F.sum(value), _sum_before)
            df = df.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).drop("_carry")
        self.df = df
        return self

    def last_seen(self, out: str, col: Column | str, inclusive: bool = False) -> "Sequence":
        """Latest non-NULL value before the row (or up to it)."""
        value = F.col(col) if isinstance(col, str) else col
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        df = self.df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
        if self.cut:
            newest = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
            df = self._carried(df, newest, _last_before)
            df = df.withColumn(out, F.coalesce(out, "_carry")).drop("_carry")
        self.df = df
        return self

    def done(self) -> DataFrame:
        return self.df.drop("_chunk", "_long")


def rank_select(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, "callable"]
) -> DataFrame:
    """Exact order statistics per group without gathering the group.

    ``ranks`` maps an output name to a function of the group size giving a 1-based rank. Equal
    values are counted first, so what is ordered is one row per distinct value.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_size"))
    seq = Sequence(counts, keys, [value]).running_sum("_upto", "_c").done()
    ranked = seq.join(sizes, keys)
    picks = []
    for name, rank in ranks.items():
        r = rank(F.col("_size"))
        hit = (F.col("_upto") >= r) & (F.col("_upto") - F.col("_c") < r)
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_size").alias("n"), *picks)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, exact, on top of ``rank_select``."""
    ranks = {}
    for name, q in wanted.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * F.lit(q)) + 1
        ranks[f"_hi_{name}"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q)) + 1
    picked = rank_select(df.where(F.col(value).isNotNull()), keys, value, ranks)
    out = []
    for name, q in wanted.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        frac = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        out.append((lo + (hi - lo) * frac).alias(name))
    return picked.select(*keys, "n", *out)
