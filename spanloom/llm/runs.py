"""Periodic runs: stretches of words that repeat with a period, found on diagonals seeded by k-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import codes_of, slices, table, text_or_empty, words_of


@dataclass(frozen=True)
class RunLimits:
    """A run has ``least`` symbols and ``times`` its period at least. ``times`` is 3 or more: the seeds rely on it."""

    least: int = 6
    times: int = 4

    def length(self, period: int) -> int:
        return max(self.least, self.times * period)

    def overlap(self, low: int) -> int:
        """Neighbouring equal pairs that a run of any period in [low, 2 low) has at least; convex in the period."""
        bend = self.least // self.times
        return min(self.length(q) - q for q in {min(max(q, low), 2 * low - 1) for q in (low, bend, bend + 1, 2 * low - 1)})


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense names of pairs: equal pairs get equal names."""
    if not len(first):
        return first
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _repeated(at: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which entries share their name with another."""
    return np.bincount(name, minlength=1)[name] > 1 if len(at) else np.zeros(0, bool)


class _Grams:
    """Names of all windows of 1, 2, 4, ... symbols that occur more than once; others are -1, as no seed has them."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.size, self.full = 1, x
        self.at = np.flatnonzero(_repeated(np.arange(self.n), x))

    def pair(self, at: np.ndarray, left: np.ndarray, right: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows made of one named by ``left`` and, ``gap`` symbols on, one named by ``right``."""
        at = at[at + gap < self.n]
        at = at[(left[at] >= 0) & (right[at + gap] >= 0)]
        return at, _named(left[at], right[at + gap])

    def doubled(self) -> "_Grams":
        at, name = self.pair(self.at, self.full, self.full, self.size)
        more = _repeated(at, name)
        out = object.__new__(_Grams)
        out.n, out.size, out.at = self.n, 2 * self.size, at[more]
        out.full = np.full(self.n, -1, np.int64)
        out.full[out.at] = name[more]
        return out


def _chains(at: np.ndarray, name: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extended seeds of one size: each k-gram meets its next occurrence only, and lags in [low, high) are kept.

    Seeds that follow one another on a diagonal are one extension: the furthest covered position of a
    lag moves on with each of them, and only a seed beyond it opens a new stretch.
    """
    by = np.lexsort((at, name))
    a, nm = at[by], name[by]
    lag = a[1:] - a[:-1]
    seed = (nm[1:] == nm[:-1]) & (lag >= low) & (lag < high)
    start, lag = a[:-1][seed], lag[seed]
    by = np.lexsort((start, lag))
    start, lag = start[by], lag[by]
    if not len(start):
        return start, start, lag
    fresh = np.concatenate([[True], (lag[1:] != lag[:-1]) | (start[1:] != start[:-1] + 1)])
    heads = np.flatnonzero(fresh)
    seeds = np.diff(np.append(heads, len(start)))
    return start[heads], seeds + k - 1 + lag[heads], lag[heads]


def periodic_runs(x: np.ndarray, doc: np.ndarray, limits: RunLimits = RunLimits()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in the symbols ``x`` of documents ``doc`` (ascending), by start and period.

    A stretch of period q that is long enough has at least ``length(q) - q`` neighbouring pairs of equal
    symbols q apart: that is the overlap every run guarantees. Lags are taken in octaves [m, 2m); their
    k-grams have the least overlap of the octave, which is longer than any of its lags. Two k-grams of a
    stretch that are nearer than its smallest period would, by the theorem of Fine and Wilf, give it a
    smaller one. So the next occurrence of a k-gram names the smallest period of the stretch, pairs of
    occurrences are as many as k-grams, and no lag that is a multiple of the period is ever tried.
    """
    if limits.times < 3:
        raise ValueError("runs of fewer than three periods have no sure seeds")
    n = len(x)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n:
        longest = int(np.bincount(doc).max())
        grams = [_Grams(_named(doc.astype(np.int64), x))]  # a symbol's name holds its document, so no window of two matches
        low = 1
        while limits.length(low) <= longest and len(grams[-1].at):
            k = limits.overlap(low)
            while grams[-1].size * 2 <= k and len(grams[-1].at):
                grams.append(grams[-1].doubled())
            parts = [g for g in grams if g.size & k]
            if k >= 2 * grams[-1].size:  # no window of half the size comes twice
                break
            at, name, done = parts[-1].at, parts[-1].full, parts[-1].size
            for g in reversed(parts[:-1]):
                at, named = g.pair(at, name, g.full, done)
                done += g.size
                name = np.full(n, -1, np.int64)
                name[at] = named
            found.append(_chains(at, name[at], low, 2 * low, k))
            low *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(p) for p in zip(*found))
    good = length >= np.maximum(limits.least, limits.times * period)
    start, length, period = start[good], length[good], period[good]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def altered(h: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """For every word of all documents, which word of them stands in its place; ``h`` is -1 where nothing changes."""
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    take = np.arange(int(n_words.sum()))
    for d in np.flatnonzero((h >= 0) & (h % 10 == 0) & (n_words > 0)):
        n, g = int(n_words[d]), int(h[d]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        take[first[d] + a:first[d] + n] = first[d] + a + np.arange(n - a) % p
    return take


def _best(runs: list[tuple[int, int, int]]) -> tuple:
    if not runs:
        return None, None, None, None
    s, n, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return s, n, q, 1000 * n // q


def _report(part: pa.RecordBatch, limits: RunLimits, texts: bool) -> pa.RecordBatch:
    flat, n_words = words_of(part.column("t"))
    take = altered(part.column("h").to_numpy(zero_copy_only=False), n_words)
    flat = flat.take(pa.array(take))
    code, _ = codes_of(flat)
    doc = np.repeat(np.arange(part.num_rows), n_words)
    start, length, period = periodic_runs(code, doc, limits)
    change = np.zeros(len(code) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    to = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=part.num_rows))])
    lists = pa.ListArray.from_arrays(pa.array(to, pa.int32()), flat.filter(pa.array(keep)))
    collapsed = pc.binary_join(lists, " ")
    ends = np.concatenate([[0], np.cumsum(n_words)])
    at = start - ends[doc[start]]
    bounds = np.searchsorted(start, ends)
    rows = [list(zip(at[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]
    best = list(zip(*map(_best, rows))) if rows else [()] * 4
    columns = [part.column("k"), pa.array(list(map(len, rows)), pa.int64()), *(pa.array(b, pa.int64()) for b in best),
               pa.array([sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in rows]),
               pa.array([sha256(c.as_buffer()).hexdigest() for c in collapsed])]
    names = ["k", *COLUMNS]
    if texts:
        pairs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (at, length, period)], ["start", "length", "period"])
        columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs), collapsed.cast(pa.string())]
        names += ["runs", "collapsed"]
    return pa.RecordBatch.from_arrays(columns, names=names)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: RunLimits = RunLimits(), alter: Column | None = None, texts: bool = False) -> DataFrame:
    """Periodic runs of every text over its words; one row per input row, columns listed below.

    ``key``, ``n_runs``; ``start, length, period, exponent_milli`` of the run with the greatest length /
    period (ties: smallest start, then period; null without a run); ``runs_sha256`` over all runs,
    ``collapsed_sha256`` over the words that stay when every run is cut down to its first period. With
    ``texts`` also ``runs`` (start, length, period) and ``collapsed``, the remaining words themselves.
    ``alter`` is a number (-1: none) by which words are replaced before the search, as the test data of
    the query ask for. Each text is worked on as a whole: memory follows the longest text, and no row
    is moved, so a source, a key or a text that fills a third of the table costs no more than others.

    Null, empty and blank texts have no words and no runs, and collapse to the empty text. Null keys
    and repeated rows give rows of their own. Other columns of ``docs`` are not carried, so none can
    clash. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            yield _report(part, limits, texts)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    h = F.lit(-1).cast("long") if alter is None else F.coalesce(alter.cast("long"), F.lit(-1).cast("long"))
    return docs.select(F.col(key).alias("k"), h.alias("h"), text_or_empty(text).alias("t")).mapInArrow(work, schema).withColumnRenamed("k", key)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of which are first made periodic as the contract says (a null id: not)."""
    return run_report(table(spark, sf_dir, "documents"), alter=F.crc32(F.col("doc_id").cast("string").cast("binary")))
