"""Suffix-array deduplication of byte strings over a whole collection, column by column."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bytes_of, slices, table, text_or_empty
from spanloom.session import written

#: Bytes hashed for an anchor; every string of the length looked for holds one that all its copies share.
ANCHOR = 32
#: Rows of aligned strings that are sorted together; one anchor's rows are never parted.
TOGETHER = 20_000
#: Bytes of aligned columns held in memory; beyond, they are read column by column from a file of the task.
IN_MEMORY = 128 << 20
#: Bits of the filter that says which documents need a join at all; a clash costs a row in it.
FILTER_BITS = 1 << 23

_G = np.random.default_rng(20)
_BYTE = _G.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


def anchored_runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows of ``length`` bytes that have the same anchor, the leftmost least hash of ``ANCHOR`` bytes.

    ``start``, ``end`` (of the first and last window of a run, in ``raw``), ``at`` (the anchor), ``anchor``
    (its hash) and ``whole`` (hash of all bytes of the run). Equal windows have the anchor at the same place.
    """
    n = len(raw)
    none = {k: np.zeros(0, np.int64) for k in ("start", "end", "at", "anchor", "whole")}
    if n < length:
        return none
    width = length - ANCHOR + 1
    h = _BYTE[raw]
    step = 1
    with np.errstate(over="ignore"):
        power = _POWER
        while step < ANCHOR:
            h = h[:-step] * power + h[step:]
            power = power * power
            step *= 2
    h = _mix(h)
    least, span = h, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(h) - width + 1], least[width - span:width - span + len(h) - width + 1])
    valid = np.zeros(n - length + 2, bool)  # the last one stays false
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            valid[a:b - length + 1] = True
    ok = valid[:-1]
    fresh = ok & ~np.concatenate([[False], ok[:-1] & (least[1:] == least[:-1])])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none
    stop = np.flatnonzero(ok & ~valid[1:])  # last windows of documents
    following = np.append(start[1:], n)
    last = stop[np.searchsorted(stop, start)]
    end = np.minimum(following - 1, last)
    entered = np.zeros(len(start), bool)  # the least hash has just come in on the right
    inner = start > 0
    entered[inner] = ok[start[inner] - 1] & (least[start[inner]] < least[start[inner] - 1])
    done = []
    at = start + width - 1
    look = np.flatnonzero(~entered)
    while len(start):
        for i in range(0, len(look), 100_000):
            some = look[i:i + 100_000]
            at[some] = start[some] + np.argmin(h[start[some][:, None] + np.arange(width)], axis=1)
        over = end > at  # equal hashes: the run goes on with the next of them
        done.append(np.stack([start, np.where(over, at, end), at]))
        start, end = at[over] + 1, end[over]
        at, look = start.copy(), np.arange(len(start))
    start, end, at = np.concatenate(done, axis=1)
    with np.errstate(over="ignore"):
        powers = np.full(n + 1, _POWER, np.uint64)
        powers[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * np.cumprod(powers)[:-1], dtype=np.uint64)])
        powers[1:] = _INVERSE
        whole = (sums[end + length] - sums[start]) * np.cumprod(powers)[start]
        whole = _mix(whole + _mix((end - start + 1).astype(np.uint64) * np.uint64(1 << 20) + (at - start).astype(np.uint64)))
    return {"start": start, "end": end, "at": at, "anchor": h[at].view(np.int64), "whole": whole.view(np.int64)}


def _rank(*columns: pa.Array) -> np.ndarray:
    """Place of each row in the order of ``columns``, nulls of the first one first; equal rows have equal places."""
    n = len(columns[0])
    rows = pa.table({f"c{i}": c for i, c in enumerate(columns)} | {"null": columns[0].is_valid(), "i": pa.array(np.arange(n))})
    rows = rows.sort_by([("null", "ascending"), *((f"c{i}", "ascending") for i in range(len(columns)))])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for i in range(1, len(columns)):  # a place, the hash of key and text, stands for the key
            x = rows.column(f"c{i}").to_numpy()
            new[1:] |= x[1:] != x[:-1]
    out = np.empty(n, np.int64)
    out[rows.column("i").to_numpy()] = np.cumsum(new)
    return out


ORDER = ["doc", "place", "start"]
RUN = "anchor long, whole long, doc {0}, place long, start long, size int, off int"


def _runs_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row per run; of equal runs in a slice only the first goes on, the others (``size`` negative) are spans already."""
    for part in slices(batches, "t", 2 << 20):
        raw, offsets = bytes_of(part.column("t"))
        r = anchored_runs(raw, offsets, length)
        doc = np.searchsorted(offsets, r["start"], side="right") - 1
        start, size, off = r["start"] - offsets[doc], r["end"] - r["start"] + 1, r["at"] - r["start"]
        place = part.column("p").to_numpy()
        rank = _rank(part.column("k"), part.column("p"))
        by = np.lexsort((start, rank[doc], r["whole"], r["anchor"]))
        a, w, d = r["anchor"][by], r["whole"][by], doc[by]
        again = np.zeros(len(by), bool)
        again[1:] = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
        twin = np.zeros(len(by), bool)  # the same document in two rows, not a copy
        twin[1:] = again[1:] & (place[d[1:]] == place[d[:-1]]) & (start[by][1:] == start[by][:-1])
        keep = ~twin
        by, again = by[keep], again[keep]
        for i in range(0, len(by), 100_000):
            x, gone = by[i:i + 100_000], again[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(gone, place[doc[x]] ^ start[x], r["anchor"][x])), pa.array(r["whole"][x]), part.column("k").take(pa.array(doc[x])),
                pa.array(place[doc[x]]), pa.array(start[x]), pa.array(np.where(gone, -size[x], size[x]).astype(np.int32)), pa.array(off[x].astype(np.int32)),
            ], names=["anchor", "whole", "doc", "place", "start", "size", "off"])


def _copies_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by anchor, hash and order: all but the first of equal runs as spans (``size`` negative), and
    the first ones where an anchor has several. One pass; it remembers the last row and what waits to be decided."""
    last: pa.RecordBatch | None = None  # first row of the last anchor's only hash so far, not given out
    anchor = whole = place = start = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, w, p, s, size = (batch.column(c).to_numpy() for c in ("anchor", "whole", "place", "start", "size"))
        done = size < 0
        pa_, pw, pp, ps = (np.concatenate([[v if v is not None else 0], x[:-1]]) for v, x in ((anchor, a), (whole, w), (place, p), (start, s)))
        same_a, same_w = a == pa_, w == pw
        if anchor is None:
            same_a[0] = False
        same_w &= same_a
        twin = same_w & (p == pp) & (s == ps)
        first = ~same_w
        # an anchor's first hash waits until the anchor shows a second one
        opens = first & ~same_a & ~done
        second = first & same_a & ~done
        group = np.cumsum(~same_a)  # 0: goes on from the batch before
        several = np.zeros(group[-1] + 1, bool)
        several[group[second]] = True
        if last is not None and several[0]:
            yield last
        if last is not None and (several[0] or group[-1] > 0):
            last = None
        waits = opens & ~several[group] & (group == group[-1])
        give = (done | (~first & ~twin) | second | opens & several[group])
        sizes = np.where(give & ~first, -np.abs(size), size).astype(np.int32)
        out = batch.set_column(batch.schema.get_field_index("size"), "size", pa.array(sizes))
        yield out.filter(pa.array(give))
        if waits.any():
            last = batch.slice(int(np.flatnonzero(waits)[-1]), 1)
        anchor, whole, place, start = a[-1], w[-1], p[-1], s[-1]


def column_wise(columns: np.ndarray, group: np.ndarray, rank: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (row, column) of aligned strings that a string of the same group with a lower rank has, too.

    ``columns`` is symbols by column and row, -1 outside of a string; windows of row r start in the columns
    ``first[r]`` to ``last[r]``. From the last column on, each round inserts one symbol of every string:
    the strings, ordered by what follows, are dealt out by the new symbol (an LF step of all at once), and
    the prefix a string shares with the one before it is one more than the least between them before.
    """
    count = len(group)
    order = np.argsort(group, kind="stable")
    shared = np.zeros(count, np.int64)
    rows, at = [], []
    for c in range(len(columns) - 1, -1, -1):
        symbol = np.asarray(columns[c])[order].astype(np.int64)
        key = group[order] * 512 + symbol + 1
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        same = np.zeros(count, bool)
        same[1:] = (sorted_key[1:] == sorted_key[:-1]) & (symbol[by][1:] >= 0)
        now = np.zeros(count, np.int64)
        j = np.flatnonzero(same)
        if len(j):
            pairs = np.stack([by[j - 1] + 1, by[j] + 1], axis=1).ravel()
            now[j] = np.minimum.reduceat(np.append(shared, 0), pairs)[::2] + 1
        order, shared = order[by], now
        if c <= len(columns) - length:
            new = shared < length
            cls = np.flatnonzero(new)
            inside = (first[order] <= c) & (c <= last[order])
            least = np.minimum.reduceat(np.where(inside, rank[order], np.iinfo(np.int64).max), cls)
            mine = np.repeat(least, np.diff(np.append(cls, count)))
            hit = inside & (rank[order] > mine)
            rows.append(order[hit])
            at.append(np.full(hit.sum(), c))
    return (np.concatenate(rows), np.concatenate(at)) if rows else (np.zeros(0, np.int64),) * 2


def _aligned(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove from strings sorted by anchor: ``place, start, end``."""
    left = length - ANCHOR
    held: list[pa.RecordBatch] = []

    def spans(rows: pa.Table) -> pa.RecordBatch:
        n, width = rows.num_rows, left + length
        off, size, start = (rows.column(c).to_numpy().astype(np.int64) for c in ("off", "size", "start"))
        if n * width * 2 > IN_MEMORY:
            columns = np.memmap(tempfile.TemporaryFile(), np.int16, "w+", shape=(width, n))
        else:
            columns = np.empty((width, n), np.int16)
        columns[:] = -1
        raw, offsets = bytes_of(rows.column("bytes").combine_chunks().cast(pa.binary()))
        lengths = np.diff(offsets)
        for c in range(width):
            inside = c - (left - off)
            ok = (inside >= 0) & (inside < lengths)
            columns[c][ok] = raw[offsets[:-1][ok] + inside[ok]]
        group = np.unique(rows.column("anchor").to_numpy(), return_inverse=True)[1]
        where = start + off
        rank = _rank(rows.column("doc").combine_chunks(), rows.column("place").combine_chunks(), pa.array(where))
        first = left - off
        row, c = column_wise(columns, group, rank, first, first + size - 1, length)
        by = np.lexsort((c, row))
        row, c = row[by], c[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (c[1:] != c[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(row)) - 1
        begin = where[row[a]] + c[a] - left
        return pa.RecordBatch.from_arrays([
            rows.column("place").combine_chunks().take(pa.array(row[a])), pa.array(begin), pa.array(begin + c[b] - c[a] + length)], names=["place", "start", "end"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= TOGETHER:
            other = np.flatnonzero(batch.column("anchor").to_numpy() != held[-1].column("anchor")[-1].as_py())
            if len(other):
                yield spans(pa.Table.from_batches([*held, batch.slice(0, int(other[0]))]))
                held, batch = [], batch.slice(int(other[0]))
        held.append(batch)
    if held:
        yield spans(pa.Table.from_batches(held))


def _flagged(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``docs`` with ``likely``: whether ``p`` may be among ``places``, by a bit table of a fixed size, 1 MB."""
    bit = F.pmod(F.xxhash64("p"), F.lit(FILTER_BITS))
    bits = (places.select(F.col("place").alias("p")).groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.col("bits").substr((F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = docs.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket", "left")
    return joined.withColumn("likely", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).select(*docs.columns, "likely")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """``place, start, end`` of bytes to remove, from ``k, p, t`` (key, place, text); spans may overlap."""
    kind = docs.schema["k"].dataType.simpleString()
    run = RUN.format(kind)
    rows = docs.select("k", "p", "t").mapInArrow(lambda b: _runs_of(b, length), run)
    copies = written(rows.repartition("anchor").sortWithinPartitions("anchor", "whole", *ORDER).mapInArrow(_copies_of, run), "repeat-runs")
    whole = copies.where("size < 0").select("place", "start", (F.col("start") - F.col("size") - 1 + length).alias("end"))
    edges = copies.where("size > 0")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 2 << 20):
            places, keys = part.column("p"), part.column("k")
            doc, out = [], {c: [] for c in ("anchor", "start", "size", "off", "bytes")}
            for i, (t, edges_) in enumerate(zip(part.column("t").to_pylist(), part.column("edges").to_pylist())):
                raw = t.encode()
                for e in edges_:
                    doc.append(i)
                    for c in ("anchor", "start", "size", "off"):
                        out[c].append(e[c])
                    out["bytes"].append(raw[e["start"]:e["start"] + e["size"] - 1 + length])
            doc_ = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(out["anchor"], pa.int64()), keys.take(doc_), places.take(doc_), pa.array(out["start"], pa.int64()),
                pa.array(out["size"], pa.int32()), pa.array(out["off"], pa.int32()), pa.array(out["bytes"], pa.binary())],
                names=["anchor", "doc", "place", "start", "size", "off", "bytes"])

    by_doc = edges.groupBy("place").agg(F.collect_list(F.struct("anchor", "start", "size", "off")).alias("edges"))  # no more than a text has
    texts = _flagged(docs, edges.select("place")).where("likely")
    strings = (texts.join(by_doc, texts["p"] == by_doc["place"]).drop("place")
               .mapInArrow(cut_out, f"anchor long, doc {kind}, place long, start long, size int, off int, bytes binary"))
    found = (strings.repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(lambda b: _aligned(b, length), "place long, start long, end long"))
    return whole.unionByName(found)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, kept: bool = False) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans long, kept_sha256 string`` of every row; with ``kept``, also the ``kept`` bytes.

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in a row with a
    smaller key (null first; equal keys by hash of the text), or earlier in the same text. Rows of the
    same key and text are one document and no copies of each other. Null and empty texts have no bytes.
    Other columns are not carried; an empty table gives no rows.
    """
    t = text_or_empty(text)
    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), t).alias("p"), t.alias("t"))
    spans = written(repeated_spans(base, length), "repeat-spans")
    by_doc = spans.groupBy("place").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # no more than a text has
    kind = docs.schema[key].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 4 << 20):
            rows = []
            for t_, spans_ in zip(part.column("t").to_pylist(), part.column("spans").to_pylist()):
                raw, merged = t_.encode(), []
                for s in sorted((s["start"], s["end"]) for s in spans_ or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                left, at = [], 0
                for a, b in merged:
                    left.append(raw[at:a])
                    at = b
                rest = b"".join([*left, raw[at:]])
                rows.append((len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if kept else None))
            n, gone, count, digest, rest = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                                              pa.array(digest, pa.string()), pa.array(rest, pa.binary())],
                                             names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    flagged = _flagged(base, spans.select("place"))
    likely = flagged.where("likely")
    touched = likely.join(by_doc, likely["p"] == by_doc["place"], "left").select("k", "t", "spans").mapInArrow(
        keep, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = flagged.where("NOT likely").select(
        "k", F.octet_length("t").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("t", 256).alias("kept_sha256"), F.col("t").cast("binary").alias("kept"))
    out = touched.unionByName(rest).withColumnRenamed("k", key)
    return out if kept else out.drop("kept")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that occur earlier."""
    return drop_repeats(table(spark, sf_dir, "documents"))
