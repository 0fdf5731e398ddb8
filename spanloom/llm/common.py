"""Helpers shared by the text operators: byte-bounded slices of Arrow batches, words, and clash-free columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a task works on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 6 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    return F.translate(column, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes in each slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, base + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


#: What this worker keeps from task to task: one thing of one owner.
_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker until another owner keeps something or a lean task starts."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what is kept and give memory that is no longer used back to the system; workers outlive their stage."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task that starts without what earlier stages left in the worker, and leaves nothing itself."""

    @wraps(work)
    def run(*args: Any, **kw: Any) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from work(*args, **kw)
        finally:
            release()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, on which Spark deletes the shuffle files of writes that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    flat = flat.filter(real)
    rows = rows[real.to_numpy(zero_copy_only=False)]
    return flat, np.bincount(rows, minlength=len(texts)).astype(np.int64)


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense integer codes of ``words`` and the word of each code."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the offsets where they start (one more than texts)."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(x.as_buffer().to_pybytes() for x in texts) if len(texts) < 64 else pc.binary_join(
        pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary())), b"")[0].as_py()
    return np.frombuffer(joined, np.uint8), offsets


def bit_table(values: DataFrame, column: str, bits: int) -> DataFrame:
    """``bucket, words`` of a bit table of a fixed size that says which values ``column`` may have: ``bits`` / 8 bytes to broadcast."""
    bit = F.pmod(F.col(column), F.lit(bits))
    table_ = values.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(
        F.bitmap_construct_agg("at").alias("bits"))
    word = lambda i: F.conv(F.hex(F.col("bits").substr(i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return table_.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("words"))  # 4 096 bytes as longs


def having_bit(rows: DataFrame, column: str, table_: DataFrame, bits: int) -> DataFrame:
    """The rows whose ``column`` may be among the values of the bit table."""
    bit = F.pmod(F.col(column), F.lit(bits))
    at = F.bitmap_bit_position(bit).cast("int")
    inside = (7 - F.shiftright(at, 3) % 8) * 8 + at % 8  # the first byte of a word is its highest
    # never null, else the column is worked out once more in a filter on that before the join
    joined = rows.withColumn("bucket", F.coalesce(F.bitmap_bucket_number(bit), F.lit(0))).join(F.broadcast(table_), "bucket")
    return joined.where(F.getbit(F.get("words", F.shiftright(at, 6)), inside) == 1).select(*rows.columns)
