"""SentencePiece encoding by streaming Viterbi, and decoding, over whole texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import kept, slices, table, text_or_empty

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Below the worst piece by this much lies a character that no piece spells.
UNKNOWN_PENALTY = 10.0
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 250_000


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: ``spelled`` id, text and score of ordinary pieces; ``first_byte`` is the id of byte 0."""

    spelled: tuple[tuple[int, str, float], ...]
    first_byte: int
    size: int

    @staticmethod
    def load(path: str) -> Pieces:
        """Read a model file on the driver; a vocabulary has a fixed, small size."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        return Pieces(tuple((i, model.id_to_piece(i), model.get_score(i)) for i in plain), next(i for i in ids if model.is_byte(i)), len(ids))


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, pieces: Pieces):
        self.first_byte = pieces.first_byte
        self.longest = max((len(p) for _, p, _ in pieces.spelled), default=1)
        self.unknown = min((s for _, _, s in pieces.spelled), default=0.0) - UNKNOWN_PENALTY
        #: A node: the nodes after it by character, and the id and score of the piece that ends there.
        self.trie: list = [{}, None, 0.0]
        for i, piece, score in pieces.spelled:
            node = self.trie
            for ch in piece:
                node = node[0].setdefault(ch, [{}, None, 0.0])
            node[1:] = i, score
        self.bytes = [b""] * pieces.size
        for i, piece, _ in pieces.spelled:
            self.bytes[i] = piece.replace(SPACE, " ").encode()
        for b in range(256):
            self.bytes[pieces.first_byte + b] = bytes([b])
        crossing = any(a != SPACE and b == SPACE for _, p, _ in pieces.spelled for a, b in zip(p, p[1:]))
        #: Between two matches no piece can lie: every path has a boundary there.
        self.cut = re.compile(".+", re.S) if crossing else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters, given out as soon as they are certain.

        Holds the scores of the last ``longest`` boundaries. A boundary stays alive while a piece from it
        may still reach new text; as soon as the backpointers of all live boundaries lead through one
        boundary, what lies before that is final, is given out and forgotten.
        """
        root, unknown, longest = self.trie[0], self.unknown, self.longest
        open_: list[tuple[float, int, dict]] = []  # pieces in the making: score and place of their start, and what may follow
        back: list[tuple] = []  # of the boundaries after ``done``
        done = at = 0
        best = 0.0
        for ch in chars:
            last = best
            open_.append((last, at, root))
            at += 1
            going, best, link, single = [], None, None, False
            for before, start, follow in open_:
                node = follow.get(ch)
                if node is not None:
                    follow, i, s = node
                    if follow:
                        going.append((before, start, follow))
                    if i is not None:
                        if best is None or before + s > best:
                            best, link = before + s, (start, i)
                        if start == at - 1:
                            single = True
            if not single and (best is None or last + unknown > best):
                best, link = last + unknown, (at - 1, ch)
            back.append(link)
            open_ = going
            if at - done >= longest and (not going or not at % (4 * longest)):
                meet = self._meet({start for _, start, _ in going} | {at}, back, done)
                if meet > done:
                    yield from self._ids(meet, back, done)
                    del back[:meet - done]
                    done = meet
        yield from self._ids(at, back, done)

    @staticmethod
    def _meet(live: set[int], back: list, done: int) -> int:
        """The last boundary that the paths to all of ``live`` share."""
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last - done - 1][0] if last > done else done)
        return live.pop()

    def _ids(self, end: int, back: list, done: int) -> list[int]:
        out: list[int] = []
        while end > done:
            end, piece = back[end - done - 1]
            if isinstance(piece, str):
                out += [self.first_byte + b for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            else:
                out.append(piece)
        return out[::-1]

    def packed(self, segment: str) -> bytes:
        ids = self.known.get(segment)
        if ids is None:
            ids = np.fromiter(self.stream(segment), np.int32).tobytes()
            if len(segment) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[segment] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a space is put before it, and a space sign of its own goes byte by byte."""
        if not text:
            return np.zeros(0, np.int32)
        sign = np.array([self.first_byte + b for b in SPACE.encode()], np.int32).tobytes()
        parts = (" " + text).split(SPACE)
        coded = (b"".join(map(self.packed, self.cut.findall(p.replace(" ", SPACE)))) for p in parts)
        return np.frombuffer(sign.join(coded), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``, without the space that was put first."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _coder(pieces: Pieces) -> Coder:
    """One coder per worker and vocabulary, so that what it remembers outlives a task, but not the stage."""
    return kept(("pieces", hash((pieces.size, pieces.first_byte, pieces.spelled))), lambda: Coder(pieces))


def encode_texts(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text: ``key, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean``.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers; ``round_trip`` says that decoding
    them gives the text again. Null and empty texts have no ids. Null keys and repeated rows give rows
    of their own; other columns are not carried. No shuffle; a very long word streams through a window.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model))  # as large as the vocabulary, whatever the table

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for part in slices(batches, "t", 2 << 20):
            texts = part.column("t").to_pylist()
            ids = [coder.encode(t) for t in texts]
            lengths = np.array([len(x) for x in ids], np.int64)
            to = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                part.column("k"), pa.array(lengths), pa.ListArray.from_arrays(to, pa.array(np.concatenate(ids), pa.int32())),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([coder.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_()),
            ], names=["k", "n_ids", "ids", "ids_sha256", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
            .mapInArrow(work, f"k {kind}, n_ids long, ids array<int>, ids_sha256 string, round_trip boolean")
            .withColumnRenamed("k", key))


def decode_ids(rows: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of every row of ids; null ids give null text."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for part in batches:
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array([None if x is None else coder.decode(x) for x in part.column("i").to_pylist()], pa.string())],
                names=["k", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(work, f"k {kind}, text string").withColumnRenamed("k", key)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the proof that they decode to it."""
    return encode_texts(table(spark, sf_dir, "documents"))
