"""Prediction by partial matching over bytes: a model counted on a corpus, and code lengths of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bytes_of, slices, table, text_or_empty, words_of
from spanloom.session import written

#: Bytes that UTF-8 never has: they stand before the start, and at the end, of a text.
START, END = 0xFE, 0xFF
#: Not a word, so it can be the end token.
END_WORD = " "
#: Entries a task sums up before it passes them on.
HELD = 400_000


@dataclass(frozen=True)
class PpmSettings:
    """``order``: bytes of context, 6 at most. ``capacity``: entries (context, byte) held in memory at once.

    The model has all contexts of the training texts. The capacity bounds the ranges of contexts it is worked
    out in, and how many of the most frequent windows are looked up in memory; all others are joined.
    ``head_words``: how many of the most frequent words are looked up in memory; all others are joined.
    """

    order: int = 5
    capacity: int = 1 << 20
    head_words: int = 1 << 18


# ---- gathering

def windows(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts, the byte with ``order`` bytes before it as one integer; and the text of each."""
    raw, offsets = bytes_of(texts)
    count = len(offsets) - 1
    pad = order + 1  # the end of one text and the start of the next
    doc = np.repeat(np.arange(count), np.diff(offsets))
    line = np.full(len(raw) + count * pad + order, START, np.uint8)
    line[np.arange(len(raw)) + doc * pad + order] = raw
    ends = offsets[1:] + np.arange(count) * pad + order
    line[ends] = END
    long = line.astype(np.int64)
    key = long[order:].copy()
    for k in range(1, order + 1):
        key |= long[order - k:len(long) - k] << (8 * k)
    real = np.ones(len(key), bool)
    real[(ends[:, None] - order + np.arange(1, pad)).ravel()] = False
    owner = np.repeat(np.arange(count), np.diff(offsets) + 1)
    return key[real], owner


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)


def corpus_counts(texts: DataFrame, order: int) -> DataFrame:
    """Counts over ``t, held_out``: ``word string, window long, n long, uses long``.

    ``n`` is how often a lower-cased word or a window of bytes occurs in the texts learned from, ``uses`` how
    often a window does in all texts (for a word, the same as ``n``). Every task sums up its rows before the
    shuffle; a text cut nowhere, a null text counted as empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, words, held = [], [], [], 0

        def passed() -> Iterator[pa.RecordBatch]:
            if keys:
                key, n = _summed(keys, counts)
                for i in range(0, len(key), 100_000):
                    k = key[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(k), pa.array(n[i:i + 100_000])], names=["word", "window", "n"])
            if words:
                total = pa.concat_tables(words).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                for b in total.to_batches(100_000):
                    yield pa.RecordBatch.from_arrays([b.column("word"), pa.nulls(b.num_rows, pa.int64()), b.column("n")], names=["word", "window", "n"])

        for part in slices(batches, "t", 1 << 20):
            window, owner = windows(part.column("t"), order)
            out = part.column("held_out").to_numpy(zero_copy_only=False)
            key, n = np.unique(window << 1 | out[owner], return_counts=True)  # the last bit: held out
            learn = part.column("t").filter(pc.invert(part.column("held_out")))
            flat, _ = words_of(learn)
            found = pc.value_counts(pc.ascii_lower(flat))
            words.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if len(learn):
                words.append(pa.table({"word": pa.array([END_WORD]), "n": pa.array([len(learn)], pa.int64())}))
            keys.append(key)
            counts.append(n)
            held += len(key) + len(found)
            if held > HELD:
                keys, counts = map(list, zip(_summed(keys, counts)))
                words = [pa.concat_tables(words).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                held = len(keys[0]) + len(words[0])
                if held > HELD // 2:
                    yield from passed()
                    keys, counts, words, held = [], [], [], 0
        yield from passed()
        pa.default_memory_pool().release_unused()

    counted = texts.mapInArrow(work, "word string, window long, n long")
    learned = F.col("word").isNotNull() | (F.col("window").bitwiseAND(1) == 0)
    return counted.groupBy("word", F.shiftright("window", 1).alias("window")).agg(
        F.sum(F.when(learned, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("uses"))


def _bucket(c: Column) -> Column:
    return F.floor(F.log2(c) * 4).cast("int")


def _least_bucket(counts: list, capacity: int) -> int:
    """Lowest bucket such that all buckets from it on have ``capacity`` entries at most."""
    total, least = 0, 1 << 30
    for b, n in sorted(counts, reverse=True):
        total += n
        if total > capacity:
            break
        least = b
    return least


def trie_entries(windows_: DataFrame, order: int) -> DataFrame:
    """``depth, entry, n`` for all contexts of 0 to ``order`` - 1 bytes; an entry is a context with the byte after it."""
    level = windows_.where("n > 0").select(F.col("window").alias("entry"), "n")
    levels = []
    for depth in range(order - 1, -1, -1):
        level = level.groupBy((F.col("entry").bitwiseAND((1 << 8 * (depth + 1)) - 1)).alias("entry")).agg(F.sum("n").alias("n"))
        level = written(level, f"ppm-depth-{depth}")
        levels.append(level.select(F.lit(depth).alias("depth"), "entry", "n"))
    entries = levels[0]
    for x in levels[1:]:
        entries = entries.unionByName(x)
    return entries


# ---- the model

class Lookup:
    """Integers to values, by open addressing in arrays."""

    EMPTY = -1

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.bits = max(4, (3 * len(keys) // 2).bit_length())
        size = 1 << self.bits
        self.slots = np.full(size, self.EMPTY, np.int64)
        self.place = np.zeros(size, np.int32)
        self.values = values
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._hash(keys[todo]) + step) & (size - 1)
            free = self.slots[at] == self.EMPTY
            self.slots[at[free]] = keys[todo[free]]
            got = self.slots[at] == keys[todo]
            self.place[at[got]] = todo[got]
            todo = todo[~got]
            step += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys.astype(np.uint64) >> np.uint64(29))
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Which key each of ``keys`` is, -1 where it is none."""
        at = self._hash(keys)
        out = np.full(len(keys), -1, np.int64)
        here = self.slots[at]
        hit = here == keys
        out[hit] = self.place[at[hit]]
        todo = np.flatnonzero(~hit & (here != self.EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            here = self.slots[at[todo]]
            hit = here == keys[todo]
            out[todo[hit]] = self.place[at[todo[hit]]]
            todo = todo[~hit & (here != self.EMPTY)]
        return out


class Ppm:
    """Escape estimation by the number of kinds (method C), with symbol exclusion.

    After a context has escaped, its bytes are excluded below it. Contexts are nested, so what is
    excluded at a depth depends on the next longer context only; sums without it are worked out once.
    """

    def __init__(self, depth: np.ndarray, entry: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        self.entries: list[Lookup] = []
        self.contexts: list[Lookup] = []
        known_keys = known_n = None
        self.left = 256.0
        for d in range(order + 1):
            own = depth == d
            keys, count = entry[own], n[own].astype(np.float64)
            by = np.argsort(keys)
            keys, count = keys[by], count[by]
            context, first = np.unique(keys >> 8, return_index=True)
            kinds = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            here = total + kinds
            below = np.ones(len(context))
            below_escape = np.zeros(len(context))
            if d and len(keys):
                at = np.searchsorted(known_keys, keys & ((1 << 8 * d) - 1))
                used = np.add.reduceat(known_n[at], first)
                parent = context & ((1 << 8 * (d - 1)) - 1)
                p = np.searchsorted(self._context_keys, parent)
                rest_kinds = self._kinds[p] - kinds
                rest = self._total[p] - used + rest_kinds
                some = rest_kinds > 0
                below[some] = rest[some]
                below_escape[some] = np.log10(rest_kinds[some] / rest[some])
            if d == 0:
                self.left = 256.0 - (kinds[0] if len(kinds) else 0)
            self.entries.append(Lookup(keys, np.log10(count), np.log10(count) - np.log10(np.repeat(here, kinds))))
            self.contexts.append(Lookup(context, np.log10(here), np.log10(kinds / here), np.log10(below), below_escape))
            known_keys, known_n = keys, count
            self._context_keys, self._kinds, self._total = context, kinds, total

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window, given the bytes before it."""
        out = np.zeros(len(key))
        top = self.entries[self.order]
        slot = top.find(key)
        hit = slot >= 0
        out[hit] = top.values[1][slot[hit]]
        todo = np.flatnonzero(~hit)
        key = key[todo]
        above = np.full(len(todo), -1, np.int64)  # the next longer context
        for d in range(self.order, -1, -1):
            here = self.contexts[d].find((key >> 8) & ((1 << 8 * d) - 1))
            if not len(self.contexts[d].values[0]):
                continue
            known = here >= 0
            sums, escape = self.contexts[d].values[0][here], self.contexts[d].values[1][here]
            after = above >= 0
            if after.any():
                longer = self.contexts[d + 1]
                sums = np.where(after, longer.values[2][above], sums)
                escape = np.where(after, longer.values[3][above], escape)
            at = self.entries[d].find(key & ((1 << 8 * (d + 1)) - 1))
            hit = known & (at >= 0)
            out[todo[hit]] += self.entries[d].values[0][at[hit]] - sums[hit]
            miss = known & ~hit
            out[todo[miss]] += escape[miss]
            rest = ~hit
            todo, key, above = todo[rest], key[rest], np.where(known, here, -1)[rest]
        if self.left > 0:
            out[todo] -= np.log10(self.left)
        return out


def _last_first(entry: np.ndarray, order: int) -> np.ndarray:
    """Contexts of entries with the last byte first, filled up to ``order`` bytes: contexts with a common end are a range."""
    context, out = entry >> 8, np.zeros(len(entry), np.int64)
    for k in range(order):
        out |= ((context >> (8 * k)) & 0xFF) << (8 * (order - 1 - k))
    return out


def window_scores(windows_: DataFrame, order: int, capacity: int) -> DataFrame:
    """``window, uses, score``: the log10 probability of each window's last byte by all contexts of the counts.

    The order by last bytes is cut into ranges of some ``capacity`` / 4 windows, at whole contexts. All that a
    range needs is its own windows, and the shorter contexts they end in: those that lie across a border
    (one a depth and border, of 256 entries at most) go to each range they touch.
    """
    spark = windows_.sparkSession
    total = windows_.count()
    parts = max(total // max(1, capacity // 4) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = windows_.where(F.pmod(F.xxhash64("window"), F.lit(max(1, total // (64 * parts)))) == 0).select("window").toArrow()  # some 64 a range
    ends = np.sort(_last_first(drawn.column("window").to_numpy(), order))
    cuts = np.unique(ends[np.arange(1, parts) * len(ends) // parts]) if len(ends) else ends

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, entry = (batch.column(c).to_numpy() for c in ("depth", "entry"))
            low = _last_first(entry, order)
            first = np.searchsorted(cuts, low, side="right")
            last = np.searchsorted(cuts, low + (np.int64(1) << (8 * (order - depth.astype(np.int64)))) - 1, side="right")
            times = last - first + 1
            row = np.repeat(np.arange(len(entry)), times)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            for i in range(0, len(row), 100_000):
                r = pa.array(row[i:i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(part[i:i + 100_000]), *(c.take(r) for c in batch.columns)], names=["part", *batch.schema.names])

    def work(rows: pa.Table) -> pa.Table:
        depth, entry, n, uses = (rows.column(c).to_numpy() for c in ("depth", "entry", "n", "uses"))
        real, own = n > 0, depth == order
        score = Ppm(depth[real], entry[real], n[real], order).log_probabilities(entry[own])
        return pa.table({"window": entry[own], "uses": uses[own], "score": score})

    every = windows_.select(F.lit(order).alias("depth"), F.col("window").alias("entry"), "n", "uses").unionByName(
        trie_entries(windows_, order).withColumn("uses", F.lit(0).cast("long")))
    dealt = every.mapInArrow(deal, "part long, depth int, entry long, n long, uses long")
    return dealt.groupBy("part").applyInArrow(work, "window long, uses long, score double")


def adaptive_length(text: bytes, order: int = 4) -> float:
    """log10 probability of one text by a model that starts empty and learns each byte after coding it."""
    seen: dict[bytes, dict[int, int]] = {}
    total = 0.0
    line = bytes([START]) * order + text + bytes([END])
    for i in range(order, len(line)):
        sym, excluded = line[i], set()
        for d in range(order, -1, -1):
            kinds = seen.get(line[i - d:i])
            if not kinds:
                continue
            open_ = {s: c for s, c in kinds.items() if s not in excluded}
            if not open_:
                continue
            whole = sum(open_.values()) + len(open_)
            if sym in open_:
                total += np.log10(open_[sym] / whole)
                break
            total += np.log10(len(open_) / whole)
            excluded |= kinds.keys()
        else:
            total -= np.log10(256 - len(excluded))
        for d in range(order + 1):
            kinds = seen.setdefault(line[i - d:i], {})
            kinds[sym] = kinds.get(sym, 0) + 1
    return total


# ---- scoring

_MODELS: dict[str, Lookup] = {}


def score_texts(docs: DataFrame, learned: Column, key: str = "doc_id", text: str = "text", settings: PpmSettings = PpmSettings()) -> DataFrame:
    """Scores of all texts by what the rows with ``learned`` hold.

    ``key, held_out boolean, n_tokens, n_known, train_tokens long, base_score double`` (words, add-half)
    and ``score double`` (log10 probability of the text's bytes and its end). Null texts are empty: one
    token, the end. A null ``learned`` counts as true. With nothing to learn from, no token is known and
    bytes are uniform. Repeated rows and null keys keep rows of their own; other columns are not carried.
    """
    spark = docs.sparkSession
    held = ~F.coalesce(learned, F.lit(True))
    base = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), held.alias("held_out"))
    counts = written(corpus_counts(base.select("t", "held_out"), settings.order), "ppm-counts")

    words = counts.where("word IS NOT NULL").select("word", "n")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = words.groupBy(_bucket(F.col("n")).alias("b")).agg(F.count("*").alias("k")).collect()
    least = _least_bucket([(r.b, r.k) for r in sizes], settings.head_words)
    head = words.where(_bucket(F.col("n")) >= least).toArrow()
    rare = words.where(_bucket(F.col("n")) < least)
    whole = np.log10(tokens + 0.5 * (kinds + 1))

    coded = written(window_scores(counts.where("window IS NOT NULL").select("window", "n", "uses"), settings.order, settings.capacity), "ppm-windows")
    sizes = coded.groupBy(_bucket(F.col("uses")).alias("b")).agg(F.count("*").alias("k")).collect()  # some 250 buckets at most
    least = _least_bucket([(r.b, r.k) for r in sizes], settings.capacity)
    often = coded.where(_bucket(F.col("uses")) >= least).toArrow()
    seldom = coded.where(_bucket(F.col("uses")) < least).select(F.col("window").alias("w"), "score")
    arrays = [often.column(c).to_numpy() for c in ("window", "score")]
    shared = spark.sparkContext.broadcast((arrays, head.column("word").combine_chunks(), head.column("n").to_numpy()))
    order, stamp = settings.order, uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, values), known, known_n = shared.value
        if stamp not in _MODELS:
            _MODELS.clear()  # before the new one is built: a worker holds one at a time
            pa.default_memory_pool().release_unused()
            _MODELS[stamp] = Lookup(keys, values)
        model, logs = _MODELS[stamp], np.log10(known_n + 0.5)
        for part in slices(batches, "t", 1 << 19):
            texts = part.column("t")
            window, owner = windows(texts, order)
            slot = model.find(window)
            there = slot >= 0
            score = np.bincount(owner[there], model.values[0][slot[there]], part.num_rows)
            late = np.flatnonzero(~there)
            late_to = np.concatenate([[0], np.cumsum(np.bincount(owner[late], minlength=part.num_rows))]).astype(np.int32)
            flat, n_words = words_of(texts)
            flat = pc.ascii_lower(flat)
            ends = pa.array([END_WORD] * part.num_rows, pa.string())
            row = np.concatenate([np.repeat(np.arange(part.num_rows), n_words), np.arange(part.num_rows)])
            flat = pa.concat_arrays([flat.cast(pa.string()), ends])
            at = pc.index_in(flat, value_set=known)
            there = pc.is_valid(at).to_numpy(zero_copy_only=False)
            hit = at.drop_null().to_numpy()
            rest = np.flatnonzero(~there)
            rest = rest[np.argsort(row[rest], kind="stable")]
            to = np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=part.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("k"), part.column("held_out"), pa.array(n_words + 1),
                pa.array(np.bincount(row[there], minlength=part.num_rows).astype(np.int64)),
                pa.array(np.bincount(row[there], logs[hit], part.num_rows).astype(np.float64)), pa.array(score.astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(to), flat.take(pa.array(rest))),
                pa.ListArray.from_arrays(pa.array(late_to), pa.array(window[late])),
            ], names=["k", "held_out", "n_tokens", "n_known", "base", "score", "rest", "late"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<string>, late array<long>"
    # written first: a row number is then the same whenever it is read
    scored = written(base.mapInArrow(work, schema).withColumn("row", F.monotonically_increasing_id()), "ppm-rows")
    tail = (scored.select("row", F.explode("rest").alias("word")).join(rare, "word", "left")
            .groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_base")))
    late = (scored.select("row", F.explode("late").alias("w")).join(seldom, "w")
            .groupBy("row").agg(F.sum("score").alias("late_score")))
    return scored.drop("rest", "late").join(tail, "row", "left").join(late, "row", "left").select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("score") + F.coalesce("late_score", F.lit(0.0))).alias("score"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id leaves no 1 by 5."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
