"""Token ids in training order: a keyed permutation of sequences, written as shards of a fixed stride."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import lean, slices, table, text_or_empty
from spanloom.session import shared_folder

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of text encoded at once; a longer single text makes a slice of its own.
ENCODED = 3 << 20
#: Fixed value: how texts are split before merging, public with this vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class ShardSettings:
    """``length``: tokens of a sequence. ``per_shard``: sequences of a shard file. ``end``: id after every text
    (and for padding the last sequence). ``key``: names the order. Ids are 16-bit little-endian.
    """

    length: int = 1024
    per_shard: int = 4096
    end: int = 50256
    key: str = "epoch-0"

    @property
    def stride(self) -> int:
        """Bytes of a record: the ids, and a line end by which a reader can check its place."""
        return 2 * self.length + 1


class Feistel:
    """A permutation of 0 .. size-1, named by a key: eight rounds over the halves of a number, walked on until inside."""

    ROUNDS = 8

    def __init__(self, size: int, key: str):
        self.size = size
        self.half = np.uint64(max(1, ((max(size, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha512(key.encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:self.ROUNDS]

    def _mixed(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if back:
            for k in self.keys[::-1]:
                left, right = right ^ self._mixed(left, k), left
        else:
            for k in self.keys:
                left, right = right, left ^ self._mixed(right, k)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (outside := np.flatnonzero(out >= self.size)).size:
            out[outside] = self._once(out[outside], back)
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


BLANK = r"[\s\v\p{Z}\x{85}\x1c-\x1f]"
#: A space with other white space, or an end of the text, beside it.
NOT_ALONE = rf"(?:^|{BLANK}) | (?:$|{BLANK})"


class Tokens:
    """Counts and encodes with one vocabulary; a word that occurs several times among the texts is encoded once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("fixed", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a space
        self.begins[[i for x, i in ranks.items() if x[:1] == b" "]] = True

    def _plain(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def ids(self, texts: pa.Array, end: list[int] = []) -> pa.Buffer:
        """The ids of all texts, 16 bits each, ``end`` after every text.

        A space between two characters that are no white space is always split off together with what
        follows, so that words count by themselves. Texts with other spaces are encoded whole.
        """
        whole = pc.match_substring_regex(texts, NOT_ALONE)
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        flat = pc.list_flatten(parts)
        later = np.ones(len(flat), bool)
        later[firsts] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        words = coded.dictionary
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        own = self._plain(f" {said}" if len(words) else "")
        starts = np.flatnonzero(self.begins[own])
        if len(starts) != len(words):
            raise ValueError("a word doesn't begin with one id that begins with a space")
        alone = list(map(self._plain, pc.if_else(whole, texts, flat.take(pa.array(firsts))).to_pylist()))
        # every word, then what each text begins with, then the end
        known = np.concatenate([own, *alone, np.array(end, "<u2")])
        edges = np.concatenate([starts, len(own) + np.cumsum([0, *map(len, alone), len(end)])])
        values = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(known)])
        order = np.full(len(flat) + len(texts), len(edges) - 2)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)  # an end after each text
        order[place[later]] = coded.indices.to_numpy(zero_copy_only=False)
        order[place[firsts]] = len(words) + np.arange(len(texts))
        taken = values.take(pa.array(order))
        return taken.buffers()[2].slice(0, int(np.frombuffer(taken.buffers()[1], np.int32)[len(order)]))

    def count(self, text: str) -> int:
        """How many ids a text has."""
        return self.ids(pa.array([text])).size // 2

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode_ordinary_batch(texts, num_threads=1)


_TOKENS: dict[str, Tokens] = {}


def _tokens(ranks: dict[bytes, int], stamp: str) -> Tokens:
    if stamp not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[stamp] = Tokens(ranks)
    return _TOKENS[stamp]


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary, read on the driver: as large for any table."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_shards(docs: DataFrame, folder: str, text: str = "text", ranks_path: str = RANKS, settings: ShardSettings = ShardSettings()) -> int:
    """Write all texts as shards into ``folder``; the number of sequences.

    Texts follow each other, each with the end id, in the order in which Spark reads ``docs``; sequence i
    holds the tokens from i * length on. Its slot is the Feistel permutation of i; shard slot // per_shard
    has it at byte stride * (slot % per_shard). A null or empty text is its end id only. An empty table
    gives no shard. Repeated rows are texts of their own; keys and other columns are not read, so null keys
    and clashing names change nothing. A very long text is encoded whole and cut like any other.

    ``docs`` is read twice: once to count the tokens of every partition, once to encode and cut them; so
    no ids are stored between. A partition that counts differently the second time is an error, so
    read ``docs`` from files. Nothing is gathered: a task cuts its own range of tokens into sequences,
    and what crosses a border travels in pieces to its slot.
    """
    spark, s = docs.sparkSession, settings
    shared, stamp = spark.sparkContext.broadcast(load_ranks(ranks_path)), uuid.uuid4().hex
    texts = docs.select(text_or_empty(text).alias("t"))

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = _tokens(shared.value, stamp), 0
        for part in slices(batches, "t", ENCODED):
            total += tokens.ids(part.column("t"), [s.end]).size // 2
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64())], names=["pid", "n"])

    totals = {r.pid: r.n for r in texts.mapInArrow(counted, "pid long, n long").collect()}  # a number for each partition
    at, base = 0, {}
    for pid in sorted(totals):
        base[pid] = at
        at += totals[pid]
    count = -(-at // s.length)
    if not count:
        return 0
    order = Feistel(count, s.key)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sequences and pieces of this partition's stretch of tokens."""
        pid = TaskContext.get().partitionId()
        tokens, o = _tokens(shared.value, stamp), base.get(pid, 0)
        for part in slices(batches, "t", ENCODED):
            ids = tokens.ids(part.column("t"), [s.end])
            end = o + ids.size // 2
            edges = np.array([o, *range((o // s.length + 1) * s.length, end, s.length), end])
            starts = edges[:-1]
            pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * (edges - o)).astype(np.int32)), ids])
            yield pa.RecordBatch.from_arrays([pa.array(order.slots(starts // s.length)), pa.array((starts % s.length).astype(np.int32)), pieces],
                                             names=["slot", "first", "piece"])
            o = end
        if o != base.get(pid, 0) + totals.get(pid, 0):
            raise ValueError(f"partition {pid} had {totals.get(pid, 0)} tokens when they were counted, and {o - base.get(pid, 0)} now")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of pieces sorted by slot and place."""
        slot, held = None, []

        def record() -> bytes:
            raw = b"".join(held)
            return raw + np.full(s.length - len(raw) // 2, s.end, "<u2").tobytes()

        for batch in batches:
            slots, out = [], []
            for x, piece in zip(batch.column("slot").to_pylist(), batch.column("piece").to_pylist()):
                if x != slot:
                    if held:
                        slots.append(slot)
                        out.append(record())
                    slot, held = x, []
                held.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(out, pa.binary())], names=["slot", "record"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([record()], pa.binary())], names=["slot", "record"])

    shards = -(-count // s.per_shard)
    shard = F.floor(F.col("slot") / s.per_shard).cast("int")
    pieces = texts.mapInArrow(cut, "slot long, first int, piece binary")
    (pieces.repartitionById(shards, shard).sortWithinPartitions("slot", "first").mapInArrow(joined, "slot long, record binary")
     .withColumn("shard", shard).sortWithinPartitions("shard", "slot")
     # bytes pass a string column unchanged: the writer puts them down as they are, and a line end after each
     .select("shard", F.col("record").cast("string").alias("record")).write.partitionBy("shard").text(f"{folder}/shards"))
    spark.createDataFrame([(count, *asdict(s).values())], "sequences long, length int, per_shard int, end int, key string").coalesce(1).write.parquet(f"{folder}/manifest")
    return count


def read_slots(spark: SparkSession, folder: str, first: int = 0, count: int | None = None) -> DataFrame:
    """``slot, shard, sequence long, record binary`` from slot ``first`` on, in ``count`` slots; opens only the shards that hold them."""
    m = spark.read.parquet(f"{folder}/manifest").first()
    s = ShardSettings(m.length, m.per_shard, m.end, m.key)
    last = m.sequences if count is None else min(m.sequences, first + count)
    order = Feistel(m.sequences, s.key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for shard, content in zip(part.column("shard").to_pylist(), part.column("content")):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                if len(raw) % s.stride or (raw[s.stride - 1::s.stride] != 10).any():
                    raise ValueError(f"shard {shard} has no stride of {s.stride} bytes")
                slot = shard * s.per_shard + np.arange(len(raw) // s.stride)
                records = raw.reshape(-1, s.stride)[:, :-1]
                keep = (slot >= first) & (slot < last)
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot[keep]), pa.array(np.full(keep.sum(), shard, np.int64)), pa.array(order.sequences(slot[keep])),
                    pa.array([r.tobytes() for r in records[keep]], pa.binary())], names=["slot", "shard", "sequence", "record"])

    files = spark.read.format("binaryFile").load(f"{folder}/shards").where((F.col("shard") >= first // s.per_shard) & (F.col("shard") * s.per_shard < last))
    return files.select("shard", "content").mapInArrow(work, "slot long, shard long, sequence long, record binary")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards, read again: where each sequence lies, and the digest of its ids."""
    folder = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    if not write_shards(table(spark, sf_dir, "documents"), folder):
        return spark.createDataFrame([], "slot long, shard long, sequence long, ids_sha256 string")
    return read_slots(spark, folder).select("slot", "shard", "sequence", F.sha2("record", 256).alias("ids_sha256"))
