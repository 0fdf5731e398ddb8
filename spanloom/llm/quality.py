"""Quality rules: maximal repeated substrings of a document from a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bytes_of, codes_of, lean, slices, table, text_or_empty, words_of


@dataclass(frozen=True)
class RepeatLimits:
    """What the suffix-array verdict allows.

    ``span_words``: shortest repeated substring that counts. ``covered_pct``: most of the words, in per
    cent, that such substrings may cover. ``longest_words``: longest substring that may occur twice.
    """

    span_words: int = 8
    covered_pct: int = 25
    longest_words: int = 100


def suffix_order(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of every document at once, and the prefix each entry shares with the one before it.

    ``x`` are symbol codes, ``doc`` the (ascending) document of each. Suffixes end with their document
    and are ordered by document first, so that no comparison leaves one. Prefix doubling; a round
    touches only suffixes that still share a rank with another.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(doc, doc, side="right")
    first = doc.astype(np.int64) * (int(x.max()) + 1) + x
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    levels = [rank.copy()]
    size = np.bincount(starts, minlength=n)
    open_ = order[size[starts] > 1]
    k = 1
    while len(open_):
        ahead = open_ + k
        inside = ahead < ends[open_]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[open_]))
        open_, second = open_[by], second[by]
        old = rank[open_]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        part = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(open_))
        group_at = np.maximum.accumulate(np.where(group, at, 0))
        part_at = np.maximum.accumulate(np.where(part, at, 0))
        rank[open_] = old + part_at - group_at
        levels.append(rank.copy())
        many = np.bincount(part_at, minlength=len(open_))
        open_ = open_[many[part_at] > 1]
        k *= 2
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[near - 1], order[near]
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        both = (i < ends[a]) & (j < ends[b])
        same = both & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])
        # equal ranks at a level mean equal prefixes of that length, which then lie inside the document
        common += np.where(same, 1 << level, 0)
    shared[near] = common
    return order, shared


def longest_repeats(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every position, how long the substring from it is that occurs elsewhere in its document, too."""
    order, shared = suffix_order(x, doc)
    out = np.zeros(len(x), np.int64)
    out[order] = np.maximum(shared, np.append(shared[1:], 0))
    return out


def covered(lengths: np.ndarray, at_least: int, fixed: int | None = None) -> np.ndarray:
    """Positions inside a repeated substring of ``at_least`` symbols; with ``fixed``, inside a window of that length."""
    n = len(lengths)
    hit = np.flatnonzero(lengths >= at_least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + (lengths[hit] if fixed is None else fixed), -1)
    return np.cumsum(change[:-1]) > 0


def maximal_spans(lengths: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the repeats that can't be made longer to the left within the same interval."""
    left = np.concatenate([[0], lengths[:-1]])
    start = np.flatnonzero((lengths >= at_least) & (left != lengths + 1))
    return start, lengths[start]


_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Bytes of text whose suffixes are sorted at once: ranks of every doubling are held, some thirty times as much.
TOGETHER = 3 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def measure(texts: pa.Array, span_words: int) -> dict[str, np.ndarray]:
    """The measures of a slice of texts, and its maximal repeats as ``spans`` (text, start word, words)."""
    count = len(texts)
    raw, offsets = bytes_of(texts)
    flat, n_words = words_of(texts)
    code, _ = codes_of(flat)
    doc = np.repeat(np.arange(count), n_words)
    lengths = longest_repeats(code, doc)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    of_line = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    line, _ = codes_of(pc.list_flatten(lines))
    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(pc.list_flatten(lines))), 0).to_numpy(zero_copy_only=False)
    of_line, line = of_line[~blank], line[~blank]
    keys = np.unique(of_line * (int(line.max()) + 1 if len(line) else 1) + line)
    kinds = np.bincount(keys // (int(line.max()) + 1 if len(line) else 1), minlength=count)
    ends = np.concatenate([[0], np.cumsum(n_words)])
    longest = np.zeros(count, np.int64)
    np.maximum.at(longest, doc, lengths)
    start, size = maximal_spans(lengths, span_words)
    return {
        "n_words": n_words,
        "word_chars": _per_text(_FIRST[raw] & ~_BREAK[raw], offsets),
        "n_symbols": _per_text(_SYMBOL[raw], offsets),
        "n_dup_lines": np.bincount(of_line, minlength=count) - kinds,
        "n_repeat_words": _per_text(covered(lengths, 5, 5), ends),
        "covered_words": _per_text(covered(lengths, span_words), ends),
        "longest_repeat": longest,
        "spans": (doc[start], start - ends[doc[start]], size),
    }


def repeat_measures(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: RepeatLimits = RepeatLimits(), spans: bool = False) -> DataFrame:
    """Repetition measures and verdict of every text; one row per input row, columns listed below.

    ``key``, the measures ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
    longest_repeat`` (long), ``base_failed``, ``kept`` (boolean) and, if asked for, ``spans``: the maximal
    repeats as (start word, words). A text is at most cut between batches, never inside: memory follows
    the longest text.

    Null and empty texts have no words: all measures 0, base_failed, not kept. Null keys and repeated
    rows each give their own row. Other columns of ``docs`` are not carried, so none can clash. An
    empty table gives no rows.
    """

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", TOGETHER):
            got = measure(part.column("t"), limits.span_words)
            columns = [part.column("k"), *(pa.array(got[m], pa.int64()) for m in MEASURES)]
            names = ["k", *MEASURES]
            if spans:
                doc, start, size = got["spans"]
                to = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["start", "words"])
                columns.append(pa.ListArray.from_arrays(pa.array(to, pa.int32()), pairs))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, " + ", ".join(f"{m} long" for m in MEASURES) + (", spans array<struct<start: long, words: long>>" if spans else "")
    found = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(work, schema)
    words, c = F.col("n_words"), F.col
    return (found
            .withColumn("base_failed", (words < 10) | (100 * c("n_repeat_words") > 20 * words))
            .withColumn("kept", ~c("base_failed") & (100 * c("covered_words") <= limits.covered_pct * words)
                        & (c("longest_repeat") <= limits.longest_words))
            .withColumnRenamed("k", key))


def verdict(got: dict[str, np.ndarray], limits: RepeatLimits) -> np.ndarray:
    """Which texts of a slice stay."""
    words = got["n_words"]
    base_failed = (words < 10) | (100 * got["n_repeat_words"] > 20 * words)
    return ~base_failed & (100 * got["covered_words"] <= limits.covered_pct * words) & (got["longest_repeat"] <= limits.longest_words)


def keep_good(docs: DataFrame, text: str = "text", limits: RepeatLimits = RepeatLimits()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; no shuffle, every row judged by itself."""

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, TOGETHER):
            yield part.filter(pa.array(verdict(measure(part.column(text), limits.span_words), limits)))

    return docs.mapInArrow(work, docs.schema)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the suffix-array verdict."""
    return repeat_measures(table(spark, sf_dir, "documents"))
