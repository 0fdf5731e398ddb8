"""Benchmark decontamination: rare seeds of two words, bounds that lose no copy, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lean, slices, table, text_or_empty, words_of

#: Seed entries looked at together; a text with more is looked at alone.
TOGETHER = 1 << 20
TRIMMED = ".,;:!?\"'()[]{}<>«»“”„‘’…|*_-–—"


@dataclass(frozen=True)
class LeakSettings:
    """``least_words``: items of fewer words match nothing, and those of more need a higher score. ``least_share``:
    alignment score, a point for each equal word and one off for each other or skipped word, as a share
    of the item's words from which a passage is a copy; ``least_score``: or the score itself.
    ``block_words``: words of test items looked for in one pass.
    """

    least_words: int = 3
    least_share: float = 0.4
    least_score: int = 13
    block_words: int = 1_000_000

    def least(self, words: int) -> int:
        """The score from which a passage is a copy of an item of so many words."""
        return math.ceil(max(min(self.least_score, self.least_share * words), min(words, self.least_words + 1)))


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without punctuation around them, and how many each text has."""
    flat, counts = words_of(texts)
    flat = pc.utf8_trim(pc.utf8_lower(flat), characters=TRIMMED)
    some = pc.not_equal(pc.binary_length(flat), 0)
    rows = np.repeat(np.arange(len(counts)), counts)[some.to_numpy(zero_copy_only=False)]
    return flat.filter(some), np.bincount(rows, minlength=len(counts)).astype(np.int64)


class Block:
    """Test items of one block: words as codes, and where each pair of neighbouring words occurs in which item.

    An alignment of score s has runs of equal words with a point off between any two, so its runs hold
    s - 1 pairs of neighbouring words or more: a passage with fewer holds no copy. And of an item's
    pairs any s - 2 can be left out as seeds: one of the others is in every copy. The commonest go.
    """

    def __init__(self, ids: list, texts: list[str | None], settings: LeakSettings):
        self.ids = ids
        flat, counts = plain_words(pa.array(texts, pa.string()))
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.items = np.split(codes, np.cumsum(counts)[:-1]) if len(counts) else []
        self.bags = [np.unique(x, return_counts=True) for x in self.items]
        self.least = np.array([settings.least(len(x)) for x in self.items], np.int64)
        key, starts = self.pairs(codes, counts), np.cumsum(counts) - counts
        self.own_pairs = [np.unique(key[a:a + n][key[a:a + n] >= 0]) for a, n in zip(starts, counts)]
        at = np.flatnonzero((key >= 0) & np.repeat(counts >= settings.least_words, counts))
        at = at[np.argsort(key[at], kind="stable")]
        self.key, self.item = key[at], np.repeat(np.arange(len(counts)), counts)[at]
        self.place = at - starts[self.item]
        #: Seeds an item keeps: of its n - 1 pairs all but s - 2.
        self.seeds = counts + 1 - self.least

    def codes(self, flat: pa.Array) -> np.ndarray:
        """Codes of words, -1 for those no item has."""
        return pc.fill_null(pc.index_in(flat, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def pairs(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each word the key of the pair with the next word of its text, -1 if there is none or no item has one of them."""
        key = np.full(len(codes), -1, np.int64)
        both = (codes[:-1] >= 0) & (codes[1:] >= 0)
        ends = np.cumsum(counts)
        both[ends[(ends > 0) & (ends < len(codes))] - 1] = False
        key[:-1][both] = codes[:-1][both] * (len(self.vocabulary) + 1) + codes[1:][both]
        return key

    def rarest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entries that are seeds, for texts that have the pairs ``low`` to ``high``: the rarest pairs there of each item."""
        change = np.zeros(len(self.key) + 1, np.int64)
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
        by = np.lexsort((self.place, np.cumsum(change)[:-1], self.item))
        owner = self.item[by]
        rank = np.arange(len(by)) - np.searchsorted(owner, owner)
        return np.sort(by[rank < self.seeds[owner]])

    def in_common(self, i: int, words: np.ndarray) -> int:
        """How many words of item ``i`` are in ``words``, each as often as in both: no alignment scores more."""
        own, n = self.bags[i]
        at = np.searchsorted(own, words)
        at = at[own[np.minimum(at, len(own) - 1)] == words]
        return int(np.minimum(np.bincount(at, minlength=len(own)), n).sum())

    def passages(self, i: int, key: np.ndarray) -> list[tuple[int, int]]:
        """Where a copy of item ``i`` may lie in words with these pairs: enough of its pairs within twice its length."""
        own, need, reach = self.own_pairs[i], int(self.least[i]) - 1, 2 * len(self.items[i])
        at = np.searchsorted(own, key)
        hit = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == key)
        if len(hit) < need:
            return []
        dense = np.flatnonzero(hit[need - 1:] - hit[:len(hit) - need + 1] < reach)
        change = np.zeros(len(hit) + 1, np.int64)
        np.add.at(change, dense, 1)
        np.add.at(change, dense + need, -1)
        hit = hit[np.cumsum(change)[:-1] > 0]
        return [(max(0, int(x[0]) - reach), int(x[-1]) + reach) for x in np.split(hit, np.flatnonzero(np.diff(hit) > reach) + 1)] if len(hit) else []


#: A score and where its passage begins, in one number.
SCORE = 1 << 32


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences, and the part of ``words`` it covers (end exclusive).

    Each cell carries where its alignment begins, so that two rows of the grid are held and no more.
    """
    fresh = np.arange(len(words) + 1)
    steps, row, best = fresh * SCORE, fresh, (0, 0, 0)
    for w in item:
        new = np.maximum(fresh, row - SCORE)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == w, SCORE, -SCORE))
        row = np.maximum.accumulate(new + steps) - steps  # a gap costs one a word
        end = int(np.argmax(row))
        if row[end] >= (best[0] + 1) * SCORE:
            best = int(row[end]) // SCORE, int(row[end]) % SCORE, end
    return best


def leaks_in(block: Block, texts: pa.Array, settings: LeakSettings) -> list[tuple[int, int, int, float, int, int]]:
    """Text, item, score, share and words of the best passage, for every text and item that reach the least."""
    flat, counts = plain_words(texts)
    codes = block.codes(flat)
    key, starts = block.pairs(codes, counts), np.concatenate([[0], np.cumsum(counts)])
    word = np.flatnonzero(key >= 0)
    low = np.searchsorted(block.key, key[word], side="left")
    high = np.searchsorted(block.key, key[word], side="right")
    word, low, high = (x[low < high] for x in (word, low, high))
    seeds = block.rarest(low, high)
    low, high = np.searchsorted(seeds, low), np.searchsorted(seeds, high)
    word, low, high = (x[low < high] for x in (word, low, high))
    doc = np.repeat(np.arange(len(counts)), counts)[word]
    ends = np.cumsum(high - low)
    out, start = [], 0
    while start < len(doc):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOGETHER, side="right"))
        if stop < len(doc):  # whole texts, one at least
            stop = int(np.searchsorted(doc, doc[stop]))
            stop = stop if stop > start else int(np.searchsorted(doc, doc[start], side="right"))
        size = high[start:stop] - low[start:stop]
        entry = seeds[np.repeat(low[start:stop], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        out += _aligned(block, codes, key, starts, np.repeat(doc[start:stop], size), np.repeat(word[start:stop], size), block.item[entry], block.place[entry])
        start = stop
    return out


def _aligned(block: Block, codes: np.ndarray, key: np.ndarray, starts: np.ndarray, doc: np.ndarray, word: np.ndarray, item: np.ndarray,
             place: np.ndarray) -> list[tuple[int, int, int, float, int, int]]:
    begin = word - place  # where the item would begin, if nothing were skipped
    by = np.lexsort((begin, item, doc))
    doc, item, begin = doc[by], item[by], begin[by]
    out = []
    edges = np.flatnonzero((doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) + 1
    for group in np.split(np.arange(len(doc)), edges) if len(doc) else []:
        d, i = int(doc[group[0]]), int(item[group[0]])
        length, first, last = len(block.items[i]), int(starts[d]), int(starts[d + 1])
        best = (0, 0, 0)
        for part in np.split(group, np.flatnonzero(np.diff(begin[group]) > 3 * length) + 1):
            a, b = max(first, int(begin[part[0]]) - length), min(last, int(begin[part[-1]]) + 2 * length)
            for x, y in block.passages(i, key[a:b]):
                words = codes[a + x:min(b, a + y)]
                if block.in_common(i, words) >= block.least[i]:
                    score, s, e = align(block.items[i], words)
                    best = max(best, (score, first - a - x - s, a + x + e - first))
        if best[0] >= block.least[i]:
            out.append((d, i, best[0], best[0] / length, -best[1], best[2]))
    return out


def blocks_of(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, settings: LeakSettings) -> Iterator[Broadcast]:
    """The test items in blocks of bounded size, each with all its seeds."""
    spark = docs.sparkSession
    items = items.select(F.col(item_key).alias("i"), text_or_empty(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.length("t") / 5 + 1), F.lit(0))).first()[0]
    count = int(total // settings.block_words) + 1
    for k in range(count):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).toArrow()  # about block_words words
        block = Block(own.column("i").to_pylist(), own.column("t").to_pylist(), settings)
        if not len(block.key):
            continue
        yield spark.sparkContext.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", settings: LeakSettings = LeakSettings()) -> DataFrame:
    """Pairs of a document and a test item that it holds a copy of, edited or not.

    ``key, item_key, score, share, first_word, end_word`` (words of the document); the best passage of
    each pair. Null or empty texts and items, and items of fewer than ``least_words`` words, match nothing.
    Null keys and repeated rows give rows of their own. Other columns are not carried. Items that don't
    fit one block are looked for block by block, each in its own pass over all documents: no join, no
    shuffle. Every passage that reaches the least score is found: seeds and bounds lose none, whichever
    pairs are rare in a slice of texts. An alignment holds two rows, so long items and texts cost time,
    the product of their words, but no memory.
    """
    kinds = [docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    schema = f"k {kinds[0]}, i {kinds[1]}, score long, share double, first_word long, end_word long"
    base = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    arrow = items.select(item_key).limit(0).toArrow().schema.field(0).type
    found = docs.sparkSession.createDataFrame([], schema)
    for shared in blocks_of(docs, items, item_key, item_text, settings):
        @lean
        def work(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part in slices(batches, "t"):
                rows = leaks_in(block, part.column("t"), settings)
                d, i, score, share, first, end = zip(*rows) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays([
                    part.column("k").take(pa.array(d, pa.int64())), pa.array([block.ids[x] for x in i], arrow), pa.array(score, pa.int64()),
                    pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    names=["k", "i", "score", "share", "first_word", "end_word"])

        found = found.unionByName(base.mapInArrow(work, schema))
    return found.withColumnsRenamed({"k": key, "i": item_key})


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               settings: LeakSettings = LeakSettings()) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, with all their columns."""
    rest = docs
    for shared in blocks_of(docs, items, item_key, item_text, settings):
        @lean
        def work(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                clean = np.ones(part.num_rows, bool)
                clean[[r[0] for r in leaks_in(shared.value, part.column(text), settings)]] = False
                yield part.filter(pa.array(clean))

        rest = rest.mapInArrow(work, docs.schema)
    return rest


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
