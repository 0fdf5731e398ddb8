"""N-gram Jaccard join: universe partition, pigeonhole on segments, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bit_table, codes_of, free_shuffles, having_bit, lean, slices, table, text_or_empty, words_of
from spanloom.llm.components import connected
from spanloom.session import written

#: Rows of a key that one group holds; a longer key is dealt out in pairs of blocks.
BLOCK = 4096
#: Bits of the table of rows whose sets are compared, 2 MB; a clash costs a text in the shuffle.
PLACE_BITS = 1 << 24
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class JaccardSettings:
    """Word shingles of ``words`` words; two sets link when 100 * intersection >= ``percent`` * union."""

    words: int = 3
    percent: int = 90


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt & 0xFFFFFFFF) * M2) ^ (x >> np.uint64(31))
        x = x * M1
        x = (x ^ (x >> np.uint64(29))) * M2
        return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as 64-bit hashes, text after text and sorted, and how many each text has.

    Words are lower-cased A-Z. A text with fewer words than a shingle has its whole sequence as the one.
    """
    flat, counts = words_of(texts)
    code, distinct = codes_of(pc.ascii_lower(flat))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))
    h = hashed[code] if len(code) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    out, sizes = [], np.zeros(len(texts), np.int64)
    grams = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            room = max(0, len(h) - k)
            grams[:room] = mixed(grams[:room] * M3 + h[k:])
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist())):
        if n >= words:
            own = np.unique(grams[end - n:end - words + 1])
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[end - n:end]:
                    whole = mixed(np.array([whole * M3 + x]))[0]
            own = np.array([whole])
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


class Plan:
    """Size bands and, for each, into how many segments the universe of shingles is cut.

    Band k holds the smaller set of a pair and band k or k+1 the larger one. Both are cut by the plan of
    band k. Linked sets differ in ``far`` shingles at most; so with allocations a_i (0: equal segment, 1:
    one shingle more or less) that sum, plus one each, to far + 1, some segment differs by a_i at most.
    """

    def __init__(self, largest: int, percent: int, docs: dict[int, int] | None = None):
        self.percent = percent
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array([*starts, starts[-1] * 100 // percent + 1], np.int64)
        top = self.starts[1:] - 1
        self.far = self.differ(top, top * 100 // percent)
        self.wide = np.zeros(len(top), np.int64)  # segments with allocation 1 come first
        self.segments = self.far + 1
        for k in range(len(top)):
            self.wide[k], self.segments[k] = self._cheapest(k, (docs or {}).get(k, 0) + (docs or {}).get(k + 1, 0))
        self.cells = 2 * np.maximum(4, (7 * top) // 20)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def _cheapest(self, k: int, docs: int) -> tuple[int, int]:
        """How many segments are wide, and how many there are: least keys written, and rows and pairs that meet by chance.

        A narrow segment costs a key and meets by chance when empty on both sides; a wide one also
        costs a key for each of its shingles, and meets when it has one shingle at most. A row that meets
        others by chance travels with its cells, some 15 times as many bytes as a key; a pair is a few comparisons.
        """
        need, size = int(self.far[k]) + 1, int(self.starts[k])
        best = None
        for wide in sorted({0, need // 8, need // 4, need // 2}):
            m = need - wide
            load = size / m
            alone, single = np.exp(-load), np.exp(-load) * (1 + load)
            keys = docs * (m + wide * load)
            rows = docs * ((m - wide) * alone + wide * single)
            pairs = docs * docs / 2 * ((m - wide) * alone ** 2 + wide * single ** 2)
            cost = keys + 15 * rows + 0.05 * pairs
            if best is None or cost < best[0]:
                best = (cost, wide, m)
        return best[1], best[2]

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


def _sides(plan: Plan, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts with shingles, by the plan of their own band and by that of the band below."""
    some = np.flatnonzero(sizes)
    own = plan.band(sizes[some])
    yield some, own
    yield some[own > 0], own[own > 0] - 1


def keys_of(plan: Plan, sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all segments of all texts, one-deletion neighbours of wide ones included, and the text of each.

    The band stands in the highest byte of a key.
    """
    starts = np.cumsum(sizes) - sizes
    keys, texts = [], []
    for some, band in _sides(plan, sizes):
        if not len(some):
            continue
        n = sizes[some]
        at = np.repeat(starts[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = sets[at]
        row = np.repeat(np.arange(len(some)), n)
        m = plan.segments[band]
        seg = (mixed(x, 1) % m[row].astype(np.uint64)).astype(np.int64)
        first = np.cumsum(m) - m
        part = mixed(x, 2)
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, first[row] + seg, part)
        owner = np.repeat(np.arange(len(some)), m)
        number = np.arange(len(sums)) - first[owner]
        with np.errstate(over="ignore"):
            near = np.flatnonzero(seg < plan.wide[band][row])
            less = sums[first[row[near]] + seg[near]] - part[near]
            for value, o, s in ((sums, owner, number), (less, row[near], seg[near])):
                b = band[o].astype(np.uint64)
                key = mixed(value + mixed(s.astype(np.uint64) * M3 + b, 3), 4)
                keys.append((key >> np.uint64(8)) | (b << np.uint64(56)))
                texts.append(some[o])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(texts)


def cells_of(plan: Plan, sets: np.ndarray, sizes: np.ndarray) -> list[list[bytes]]:
    """Per side and text, four bits for each of many small parts of the universe: sets differ in no fewer shingles than cells."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for some, band in _sides(plan, sizes):
        side = [b""] * len(sizes)
        for i, k in zip(some.tolist(), band.tolist()):
            x = sets[starts[i]:starts[i] + sizes[i]]
            cell = np.zeros(plan.cells[k], np.uint64)
            np.add.at(cell, (mixed(x, 5) % np.uint64(plan.cells[k])).astype(np.int64), mixed(x, 6))
            four = (cell >> np.uint64(60)).astype(np.uint8)
            side[i] = (four[::2] << 4 | four[1::2]).tobytes()
        out.append(side)
    return out


_DIFFERENT = np.array([(x >> 4 > 0) + (x & 15 > 0) for x in range(256)], np.uint8)


def near_pairs(plan: Plan, vertex: np.ndarray, size: np.ndarray, cells: np.ndarray, root: np.ndarray, forest: bool) -> list[tuple[int, int]]:
    """Pairs of one group, of different roots, that may link; all, or a forest of them over the roots, likeliest first."""
    found = []
    for i in range(len(vertex) - 1):
        other = slice(i + 1, None)
        ok = (root[other] != root[i]) & (100 * np.minimum(size[other], size[i]) >= plan.percent * np.maximum(size[other], size[i]))
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            apart = _DIFFERENT[cells[j] ^ cells[i]].sum(1, dtype=np.int64)
            close = apart <= plan.differ(size[j], size[i])
            found.append(np.stack([apart[close], np.full(close.sum(), i), j[close]]))
    if not found:
        return []
    apart, i, j = np.concatenate(found, axis=1)
    if forest:
        _, tree_of = np.unique(root, return_inverse=True)
        tree, kept = list(range(int(tree_of.max()) + 1)), []

        def top(x: int) -> int:
            while tree[x] != x:
                tree[x] = tree[tree[x]]
                x = tree[x]
            return x

        for k in np.argsort(apart, kind="stable").tolist():
            a, b = top(int(tree_of[i[k]])), top(int(tree_of[j[k]]))
            if a != b:
                tree[max(a, b)] = min(a, b)
                kept.append(k)
        i, j = i[kept], j[kept]
    return list(zip(vertex[i].tolist(), vertex[j].tolist()))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``columns`` in sorted batches, one table after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows, bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        head = tuple(a[0] for a in arrays)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        start = 0
        for cut in cuts.tolist():
            held.append(batch.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, start = [], cut
        held.append(batch.slice(start))
        last = tuple(a[-1] for a in arrays)
    if held:
        yield pa.Table.from_batches(held)


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows of ``key, v`` whose key has another ``v``: one ordered pass, a key held nowhere as a whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_v = None
        passed = False  # whether the last row before this batch has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            key, v = batch.column("key").to_numpy(), batch.column("v").to_numpy()
            if last_key is not None:
                key, v = np.append(last_key, key), np.append(last_v, v)
            # sorted by key and v: a repeated row is dropped, a key is shared if it has a neighbour with another v
            fresh = np.append(True, (key[1:] != key[:-1]) | (v[1:] != v[:-1]))
            was = passed
            idx = np.flatnonzero(fresh)
            k, x = key[idx], v[idx]
            same = k[1:] == k[:-1]
            shared = np.append(False, same) | np.append(same, False)
            give = shared.copy()
            if last_key is not None and was:
                give[0] = False
                shared[0] = True
            keep_last = shared[-1]
            yield pa.RecordBatch.from_arrays([pa.array(k[give]), pa.array(x[give])], names=["key", "v"])
            last_key, last_v, passed = key[-1:], v[-1:], bool(keep_last)

    return rows.repartition("key").sortWithinPartitions("key", "v").mapInArrow(work, "key long, v long")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: JaccardSettings = JaccardSettings()) -> DataFrame:
    """``key, n_shingles long, component_id`` of every row: its set's size and its component.

    For joins with the rows themselves also ``v`` and ``root``, the hash of its set and the least one of its
    component, and ``place``, the hash of its key and text.

    ``component_id`` is the smallest key reachable over links, its own included. Null, empty and blank
    texts have no set (``v`` null) and link with nothing; equal sets share ``v``. Sets are compared as 64-bit
    hashes of their shingles. A null key takes part, but names no component that has another key.
    Repeated rows keep rows of their own; other columns are not carried. An empty table gives no rows.
    """
    base = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), _place(key, text).alias("p"))
    kind, words, percent = docs.schema[key].dataType.simpleString(), settings.words, settings.percent

    @lean
    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets, sizes = shingle_sets(part.column("t"), words)
            bands = Plan(int(sizes.max()), percent)  # bands and cells of a size are the same in every plan
            own, below = (cells_of(bands, sets, sizes) + [[b""] * len(sizes)])[:2]
            yield pa.RecordBatch.from_arrays([
                part.column("k"), pa.array(sizes), _hashes(sets, sizes), part.column("p"), pa.array(bands.band(np.maximum(sizes, 1))),
                pa.array(own, pa.binary()), pa.array(below, pa.binary())], names=["k", "n", "v", "p", "band", "own", "below"])

    free_shuffles(docs.sparkSession)
    described = written(base.mapInArrow(sizes_of, f"k {kind}, n long, v long, p long, band long, own binary, below binary"), "jaccard-sizes")
    known = described.select("k", "n", "v", "p")
    largest = known.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bands = Plan(largest, percent)
    counted = known.groupBy("n").agg(F.count("*").alias("c"))
    starts = bands.starts.tolist()  # a few hundred bands at most
    by_band = counted.withColumn("b", sum((F.col("n") >= s).cast("int") for s in starts) - 1).groupBy("b").agg(F.sum("c").alias("c")).collect()
    plan = Plan(largest, percent, {r.b: r.c for r in by_band})

    @lean
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets, sizes = shingle_sets(part.column("t"), words)
            keys, owner = keys_of(plan, sets, sizes)
            v = _hashes(sets, sizes).fill_null(0).to_numpy()[owner]
            for i in range(0, len(keys), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 500_000]), pa.array(v[i:i + 500_000])], names=["key", "v"])

    met = written(shared_keys(base.select("t").mapInArrow(indexed, "key long, v long")), "jaccard-keys")
    wanted = met.select("v").distinct()
    # a row for each set that shares a key; equal sets have the same one. Sets are made again for those pairs only that cells leave
    chosen = known.join(wanted, "v", "left_semi").groupBy("v").agg(F.min("p").alias("p"))
    free_shuffles(docs.sparkSession)
    small = written(described.drop("k").join(chosen, ["v", "p"], "left_semi").dropDuplicates(["v", "p"]), "jaccard-cells")
    free_shuffles(docs.sparkSession)

    @lean
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets, sizes = shingle_sets(part.column("t"), words)
            to = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([_hashes(sets, sizes), pa.array(sizes), pa.ListArray.from_arrays(to, pa.array(sets.view(np.int64)))], names=["v", "n", "s"])

    band_of = F.shiftrightunsigned("key", 56)

    def mixed_rows(root: DataFrame) -> DataFrame:
        """Rows of keys that still have sets of different components, dealt out in groups, with their cells."""
        rooted = met.join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
        open_ = (rooted.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
                 .where("low < high").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
        rows = rooted.join(open_, "key").withColumn("mine", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.join(small.drop("p"), "v")
        return rows.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "v", "n", "root",
                           F.when(F.col("band") == band_of, F.col("own")).otherwise(F.col("below")).alias("cells"))

    def candidates(root: DataFrame, forest: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for run in _runs(batches, ["key", "low", "high"]):
                roots = run.column("root").to_numpy()
                if (roots == roots[0]).all():
                    continue
                cells = run.column("cells").to_pylist()
                width = max(map(len, cells))
                table_ = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cells), np.uint8).reshape(len(cells), width)
                for x, y in near_pairs(plan, run.column("v").to_numpy(), run.column("n").to_numpy(), table_, roots, forest):
                    a.append(min(x, y))
                    b.append(max(x, y))
                if len(a) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    a, b = [], []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return (mixed_rows(root).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
                .mapInArrow(work, "a long, b long").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "jaccard-pairs")
        free_shuffles(docs.sparkSession)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        places = small.join(ends, "v", "left_semi").select("p")
        some = having_bit(base.select("t", "p"), "p", bit_table(places, "p", PLACE_BITS), PLACE_BITS).join(places, "p", "left_semi").dropDuplicates(["p"])
        sized = written(some.mapInArrow(shingled, "v long, n long, s array<long>"), "jaccard-sets")
        free_shuffles(docs.sparkSession)
        joined = (pairs.join(sized.toDF("a", "na", "sa"), "a").join(sized.toDF("b", "nb", "sb"), "b"))
        both = F.size(F.array_intersect("sa", "sb"))
        return written(joined.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), "jaccard-links")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            most = plan.differ(na, nb)
            close = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            for i, (x, y) in enumerate(zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist())):
                if close[i]:
                    close[i] = _DIFFERENT[np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)].sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(close))

    # each set with the least of each of its keys: enough for most groups of copies; cells leave out what met by chance
    least_of = met.groupBy("key").agg(F.min("v").alias("a"))
    star = met.join(least_of, "key").where("v <> a").groupBy("a", F.col("v").alias("b")).agg(F.min(band_of).alias("k"))
    cells = lambda x: F.when(F.col(f"band_{x}") == F.col("k"), F.col(f"own_{x}")).otherwise(F.col(f"below_{x}"))
    side = lambda x: small.select(F.col("v").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("band", "own", "below")), F.col("n").alias(f"n{x}"))
    sized = (star.join(side("a"), "a").select("a", "b", "k", "na", cells("a").alias("ca"))
             .join(side("b"), "b").select("a", "b", "na", "nb", "ca", cells("b").alias("cb")))
    links = verified(sized.mapInArrow(likely, "a long, b long"))
    root = connected(links)
    # keys with several components: the likeliest pairs between them, a forest for each key, and then all that are left
    for forest in (True, False):
        more = verified(candidates(root, forest))
        if not more.isEmpty():
            links = links.unionByName(more)
            root = connected(links)
    least = known.where("v IS NOT NULL").groupBy("v").agg(F.min("k").alias("k"))
    named = least.join(root, "v", "left").withColumn("root", F.coalesce("root", "v"))
    component = named.join(named.groupBy("root").agg(F.min("k").alias("component_id")), "root").select("v", "root", "component_id")
    return known.join(component, "v", "left").select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("v").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"),
        "v", "root", F.col("p").alias("place"))


def _place(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), text_or_empty(text))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: JaccardSettings = JaccardSettings(5, 80)) -> DataFrame:
    """``docs`` with one row of each component, all columns: the smallest key, then the least hash of key and text.

    Rows without words stay, all of them. Of rows alike in key and text one stays.
    """
    classes = jaccard_classes(docs, key, text, settings).where("v IS NOT NULL")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col(key).alias("k"), "place")).alias("first")).select(F.col("first.place").alias("__place"))
    some = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(some).withColumn("__place", _place(key, text)).join(first, "__place", "left_semi").dropDuplicates(["__place"])
    return kept.select(*docs.columns).unionByName(docs.where(~some))


def _hashes(sets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A 64-bit hash of every set, null for an empty one."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets, 7), dtype=np.uint64)])
    with np.errstate(over="ignore"):
        out = mixed(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64) * M3, 8)
    return pa.array(out.view(np.int64), mask=sizes == 0)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles share nine tenths."""
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("v", "root", "place")
