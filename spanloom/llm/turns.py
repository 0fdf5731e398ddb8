"""Repair of conversations: the cheapest edits that make roles alternate, and of those the least audit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import slices, table
from spanloom.session import written

#: Rows of a block, the unit that one call works on. A power of two below 2 ** 33, so that no block crosses a partition.
BLOCK = 1 << 16

BLANKS = " \t\n\x0b\x0c\r"
SYSTEM, USER, ASSISTANT, OTHER = range(4)  # initials of roles
SOUND, TRUNCATED, DELETED = range(3)  # what a row's fault asks for
END, BORDER = 12, 13  # after the rows' own codes, 4 * fault + initial: the end of a conversation, the end of a piece
START, HEADED, ASKED, ANSWERED = range(4)  # states of (s?(ua)+)?: nothing yet, after s, after u, after a
LETTERS = "$DIKR"  # in ASCII order; $ ends an audit and is not shown
FAR = np.int64(1) << 60


@dataclass(frozen=True)
class EditCosts:
    """What an edit costs; keeping is free. ``truncated`` is added for every truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


_REPLY = {START: ASKED, HEADED: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}  # the state after the next user or assistant row
_KEPT = {(START, SYSTEM): HEADED, (START, USER): ASKED, (HEADED, USER): ASKED, (ANSWERED, USER): ASKED, (ASKED, ASSISTANT): ANSWERED}


class Arcs:
    """The edits by code of a row, state and slot: letter (place in ``LETTERS``), cost and state after.

    A slot without an arc costs ``FAR``. Several slots of a state may have the same letter; ranks tell them apart.
    """

    def __init__(self, costs: EditCosts = EditCosts()):
        self.letter = np.zeros((14, 4, 4), np.int64)
        self.cost = np.full((14, 4, 4), FAR)
        self.to = np.zeros((14, 4, 4), np.int64)
        for code in range(END + 1):
            fault, initial = divmod(code, 4)
            for state in range(4):
                arcs = [("I", costs.insert, _REPLY[state])]
                if code == END:
                    if state in (START, ANSWERED):
                        arcs.append(("$", 0, START))
                else:
                    arcs.append(("D", costs.delete, state))
                    extra = costs.truncated if fault == TRUNCATED else 0
                    if fault != DELETED:
                        arcs.append(("R", costs.rerole + extra, _REPLY[state]))
                        if (state, initial) in _KEPT:
                            arcs.append(("K", extra, _KEPT[state, initial]))
                for slot, (letter, cost, to) in enumerate(arcs):
                    self.letter[code, state, slot] = LETTERS.index(letter)
                    self.cost[code, state, slot], self.to[code, state, slot] = cost, to
        self.moves = self._moves()

    def _moves(self) -> np.ndarray:
        """Per code, the least cost from every state before a row to every state after it, inserts first."""
        inserts = np.full((4, 4), FAR)
        rows = np.full((14, 4, 4), FAR)
        insert = LETTERS.index("I")
        for state in range(4):
            inserts[state, state] = 0
            for code in range(END + 1):
                for letter, cost, to in zip(self.letter[code, state], self.cost[code, state], self.to[code, state]):
                    into = inserts if letter == insert else rows[code]
                    into[state, to] = min(into[state, to], cost)
        for _ in range(2):
            inserts = np.minimum(FAR, (inserts[:, :, None] + inserts[None]).min(1))
        return np.minimum(FAR, (inserts[None, :, :, None] + rows[:, None]).min(2))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(FAR, (a[:, :, :, None] + b[:, None, :, :]).min(2))


def suffix_moves(code: np.ndarray, ends: np.ndarray, arcs: Arcs) -> np.ndarray:
    """For every row, the least cost from each state before it to each state at ``ends``, the end of its piece.

    Products of 1, 2, 4, ... rows: as many rounds as the longest piece has binary digits.
    """
    moves = arcs.moves[code]
    at = np.arange(len(code))
    step = 1
    while True:
        more = at[at + step < ends[at]]
        if not len(more):
            return moves
        moves[more] = _joined(moves[more], moves[more + step])
        step *= 2
        at = more


@dataclass
class Solved:
    """Cheapest audits of pieces from given states: letters and the state after each, joined; ``sizes`` per start."""

    cost: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray
    states: np.ndarray
    leaves: np.ndarray


def solve(codes: list[np.ndarray], last: np.ndarray, after: np.ndarray, starts: list[list[int]], arcs: Arcs) -> Solved:
    """The least cheapest audit of every piece from each of its ``starts``.

    ``after`` is the cost from each state at the end of a piece to the end of its conversation; the last piece of a
    conversation has an END row of its own. Nodes are (row, state). Only arcs on a cheapest path count. A node's rank for 1, 2, 4, ...
    letters orders the least audits of that length; beside it stand the row and the set of states that the least
    audit may have reached, and the next rank is that of the pair (own rank, least rank among them). Equal audits
    have as many inserts, so the states reached lie on one row. Ranks then choose a node's arc among those of its
    least letter, and the path is read through pointers of 1, 2, 4, ... arcs.
    """
    tail = [np.array([END, BORDER]) if x else np.array([BORDER]) for x in last]
    code = np.concatenate([v for pair in zip(codes, tail) for v in pair]).astype(np.int64)
    sizes = np.array([len(c) + len(t) for c, t in zip(codes, tail)])
    stop = np.cumsum(sizes)
    first = stop - sizes
    n = len(code)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    moves = suffix_moves(code, (stop - 1)[piece], arcs)
    target = np.where(last[:, None], np.where(np.arange(4) == START, 0, FAR), after)
    left = np.minimum(FAR, (moves + target[piece][:, None, :]).min(2))
    left[stop - 1] = target
    # arcs on a cheapest path
    row = np.arange(n)
    letter = arcs.letter[code].reshape(4 * n, 4)
    step = np.where(letter == LETTERS.index("I"), 0, 1)
    goal = np.minimum(np.repeat(row, 4)[:, None] + step, n - 1) * 4 + arcs.to[code].reshape(4 * n, 4)
    total = left.reshape(-1)
    cost = arcs.cost[code].reshape(4 * n, 4)
    good = (cost < FAR) & (total[:, None] < FAR) & (cost + total[goal] == total[:, None])
    ended = ~good.any(1)
    least = np.where(good, letter, len(LETTERS)).min(1)
    chosen = good & (letter == least[:, None])
    # ranks by audits of 1, 2, 4, ... letters
    rank = np.where(ended, 0, least + 1)
    node = np.arange(4 * n)
    spot = np.where(ended, node // 4, (goal // 4)[node, chosen.argmax(1)])
    reach = np.where(ended, 1 << node % 4, np.where(chosen, 1 << goal % 4, 0).sum(1))
    lanes = np.arange(4)
    while not ended[spot * 4].all() or (reach & (reach - 1)).any():
        near = spot[:, None] * 4 + lanes
        inside = (reach[:, None] >> lanes) & 1 == 1
        ranks = np.where(inside, rank[near], 4 * n + 9)
        low = ranks.min(1)
        same = inside & (ranks == low[:, None])
        reached = np.bitwise_or.reduce(np.where(same, reach[near], 0), axis=1)
        fresh = np.unique(rank * (4 * n + 10) + low, return_inverse=True)[1]
        spot = spot[near[node, same.argmax(1)]]
        stuck = (reached == reach).all() and (fresh == rank).all() and ended[spot * 4].all()
        rank, reach = fresh, reached
        if stuck:
            break
    # the arc of the least rank behind the least letter, and pointers over 1, 2, 4, ... arcs
    slot = np.where(chosen, rank[goal], 4 * n + 9).argmin(1)
    pointer = np.where(ended, node, goal[node, slot])
    pointers = [pointer]
    while not ended[pointers[-1]].all():
        pointers.append(pointers[-1][pointers[-1]])
    begin = np.array([first[p] * 4 + s for p, states in enumerate(starts) for s in states], np.int64)
    count = _steps(begin, pointers, ended)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    path = np.repeat(begin, count)
    for k, jump in enumerate(pointers):
        path = np.where((at >> k) & 1 == 1, jump[path], path)
    return Solved(total[begin], count, least[path], pointer[path] % 4, pointers[-1][begin] % 4)


def _steps(begin: np.ndarray, pointers: list[np.ndarray], ended: np.ndarray) -> np.ndarray:
    """How many arcs lie between each node and the end of its path: the longest jumps that don't reach it, and one."""
    at, steps = begin.copy(), np.zeros(len(begin), np.int64)
    for k in range(len(pointers) - 1, -1, -1):
        ahead = pointers[k][at]
        go = ~ended[ahead]
        steps += np.where(go, 1 << k, 0)
        at = np.where(go, ahead, at)
    return np.where(ended[begin], 0, steps + 1)


PIECE = ("c string, blk long, first_id long, codes binary, turns long, low long, high long, first_turn long, last_turn long, "
         "blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int")
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _pieces(group: pa.Table) -> pa.Table:
    """What a block has of each conversation, in order; rows that only name their conversation have no ``code``."""
    group = group.sort_by("id").combine_chunks()
    c = group.column("c").combine_chunks().dictionary_encode()
    of = c.indices.to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    ids = group.column("id").to_numpy()
    code = pc.fill_null(group.column("code"), -1).to_numpy()
    fault = group.column("fault").to_numpy()
    rows = []
    for a, b in zip(heads, np.append(heads[1:], len(of))):
        a_live = a + int((code[a:b] < 0).sum())  # they come first
        own = code[a_live:b].astype(np.uint8)
        turn = group.column("turn").slice(a_live, b - a_live)
        real = turn.drop_null().to_numpy()
        initial = own % 4
        pairs = sum(int(((initial[:-1] == x) & (initial[1:] == y)).sum()) for x, y in _LEGAL)
        marks = np.bincount(fault[a_live:b], minlength=4)
        live = b > a_live
        rows.append((c.dictionary[int(of[a])].as_py(), int(group.column("blk")[0].as_py()), int(ids[a_live]) if live else None, own.tobytes(),
                     len(np.unique(real)), *((int(real[0]), int(real[-1])) if len(real) else (None, None)),
                     turn[0].as_py() if live else None, turn[len(turn) - 1].as_py() if live else None,
                     int(marks[1]), int(marks[2]), int(marks[3]), max(len(own) - 1, 0) - pairs,
                     int(initial[0]) if live else None, int(initial[-1]) if live else None))
    return _table(PIECE, list(zip(*rows)))


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()),
          "array<binary>": pa.list_(pa.binary())}


def _table(schema: str, columns: list) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table([pa.array(v, _KINDS[kind]) for (_, kind), v in zip(fields, columns or [[]] * len(fields))], names=[n for n, _ in fields])


def _codes(part: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer() or b"", np.uint8) for v in part.column("codes")]


def _solved(part: pa.RecordBatch, arcs: Arcs, states: list[int]) -> tuple[list[int], list[bytes], list[bytes], list[int]]:
    last = np.array([k == of for k, of in zip(part.column("k").to_pylist(), part.column("of").to_pylist())])
    after = np.array([v or [FAR] * 4 for v in part.column("after").to_pylist()], np.int64).reshape(-1, 4)
    got = solve(_codes(part), last, after, [states] * part.num_rows, arcs)
    shown = np.frombuffer(LETTERS.encode(), np.uint8)[got.letters]
    to = np.concatenate([[0], np.cumsum(got.sizes)])
    letters, after_each = shown.tobytes(), got.states.astype(np.uint8).tobytes()
    cut = [int(b) - (b > a and letters[b - 1:b] == b"$") for a, b in zip(to[:-1], to[1:])]
    return got.cost.tolist(), [letters[a:b] for a, b in zip(to, cut)], [after_each[a:b] for a, b in zip(to, cut)], got.leaves.tolist()


def _solve_whole(pieces: DataFrame, costs: EditCosts) -> DataFrame:
    """Conversations of one piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs = Arcs(costs)
        for part in slices(batches, "codes", BLOCK):
            cost, letters, states, _ = _solved(part, arcs, [START])
            yield from _table("c string, k long, first_id long, cost long, letters binary, states binary", [
                part.column("c").to_pylist(), part.column("k").to_pylist(), part.column("first_id").to_pylist(), cost, letters, states]).to_batches()

    rows = pieces.select("c", "k", "of", "first_id", "codes", F.lit(None).cast("array<long>").alias("after"))
    return rows.mapInArrow(work, "c string, k long, first_id long, cost long, letters binary, states binary")


def _solve_parts(pieces: DataFrame, costs: EditCosts) -> DataFrame:
    """Conversations of several pieces: costs to the end go backward over one product a piece, states forward over one map a piece."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs = Arcs(costs)
        for part in slices(batches, "codes", BLOCK):
            out = []
            for codes, k, of in zip(_codes(part), part.column("k").to_pylist(), part.column("of").to_pylist()):
                code = np.append(codes, END) if k == of else codes
                whole = suffix_moves(code.astype(np.int64), np.full(len(code), len(code)), arcs)[:1] if len(code) else np.where(np.eye(4), 0, FAR)[None]
                out.append(whole.reshape(-1).tolist())
            yield from _table("c string, k long, moves array<long>", [part.column("c").to_pylist(), part.column("k").to_pylist(), out]).to_batches()

    def backward(group: pa.Table) -> pa.Table:
        group = group.sort_by([("k", "descending")])
        left, out = np.array([0, FAR, FAR, FAR]), []
        for moves in group.column("moves").to_pylist():
            out.append(left.tolist())
            left = np.minimum(FAR, (np.array(moves).reshape(4, 4) + left).min(1))
        return _table("c string, k long, after array<long>", [group.column("c").to_pylist(), group.column("k").to_pylist(), out])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs = Arcs(costs)
        for part in slices(batches, "codes", BLOCK):
            cost, letters, states, leaves = _solved(part, arcs, [0, 1, 2, 3])
            four = lambda v: [v[i:i + 4] for i in range(0, len(v), 4)]
            yield from _table("c string, k long, first_id long, cost array<long>, letters array<binary>, states array<binary>, leaves array<long>", [
                part.column("c").to_pylist(), part.column("k").to_pylist(), part.column("first_id").to_pylist(),
                four(cost), four(letters), four(states), four(leaves)]).to_batches()

    def forward(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        state, out = START, []
        for leaves in group.column("leaves").to_pylist():
            out.append(state)
            state = leaves[state]
        return _table("c string, k long, enters long", [group.column("c").to_pylist(), group.column("k").to_pylist(), out])

    products = pieces.select("c", "k", "of", "codes").mapInArrow(product, "c string, k long, moves array<long>")
    after = products.groupBy("c").applyInArrow(backward, "c string, k long, after array<long>")
    rows = pieces.select("c", "k", "of", "first_id", "codes").join(after, ["c", "k"])
    found = written(rows.mapInArrow(every, "c string, k long, first_id long, cost array<long>, letters array<binary>, states array<binary>, leaves array<long>"), "audits")
    enters = found.select("c", "k", "leaves").groupBy("c").applyInArrow(forward, "c string, k long, enters long")
    own = lambda name: F.element_at(name, (F.col("enters") + 1).cast("int")).alias(name)
    return found.join(enters, ["c", "k"]).select("c", "k", "first_id", own("cost"), own("letters"), own("states"))


def _steps_of(solved: DataFrame) -> DataFrame:
    """``c, k, nr, id, edit, state`` of every edit that leaves a row; ``id`` is the row it is about, null for an insert."""
    schema = "c string, k long, nr long, id long, edit string, state int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "letters", BLOCK):
            for c, k, first, letters, states in zip(*(part.column(x).to_pylist() for x in ("c", "k", "first_id", "letters", "states"))):
                letter = np.frombuffer(letters, np.uint8)
                insert = letter == ord("I")
                stay = np.flatnonzero(letter != ord("D"))
                if len(stay):
                    ids = (first or 0) + np.cumsum(~insert) - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c] * len(stay), pa.string()), pa.array([k] * len(stay), pa.int64()), pa.array(stay, pa.int64()),
                        pa.array(ids[stay], pa.int64(), mask=insert[stay]), pa.array([chr(x) for x in letter[stay]]),
                        pa.array(np.frombuffer(states, np.uint8)[stay].astype(np.int32))], names=["c", "k", "nr", "id", "edit", "state"])

    return solved.select("c", "k", "first_id", "letters", "states").mapInArrow(work, schema)


@dataclass
class Repair:
    """``summary``: one row per conversation; ``rows``: the repaired rows, numbered by (piece, nr) within ``c``."""

    summary: DataFrame
    rows: DataFrame


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None,
           costs: EditCosts = EditCosts(), block: int = BLOCK) -> Repair:
    """Faults of every conversation, its cheapest repair and the least audit that tells it.

    ``summary``: ``conv``, ``gaps, blank, duplicate, truncated, illegal, cost`` (long) and ``audit``, the edits' initials. ``rows``: ``c`` (the
    conversation as text), ``piece, nr`` (their order), ``edit``, ``role``, ``text``. Rows for which ``live`` is not true have no
    part in it but to name their conversation.

    Rows are ordered by turn, nulls first; ties by role, then by the MD5 of the text, so that the result
    does not depend on the order of files. Null conversations are one conversation, null roles and texts
    are one space, and an initial other than s, u and a (an empty role has none) can't be kept. Repeated
    rows are duplicates. An empty table gives no rows. Other columns are not carried, so none can clash.

    Nothing is gathered by conversation but one 4 x 4 product and one map of states for every ``block``
    rows of it: rows are sorted over ranges, cut into blocks wherever they fall, and a conversation of
    any length is worked on piece by piece. A text travels by its digest until the repaired rows fetch it.
    """
    if block & (block - 1) or block > BLOCK:
        raise ValueError("block is a power of two, 65 536 at most")
    kind = turns.schema[conv].dataType.simpleString()
    blanks = F.lit(BLANKS)
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("c"), F.coalesce(live, F.lit(False)).alias("live") if live is not None else F.lit(True).alias("live"),
        F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    trimmed = F.rtrim("text", blanks)
    first = F.substring("role", 1, 1)
    slim = rows.select(
        "c", "live", F.when(F.col("live"), F.col("turn")).alias("turn"), F.when(F.col("live"), F.col("role")).alias("role"),
        F.when(F.col("live"), F.md5("text")).alias("digest"),
        F.when(~F.col("live"), None).when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER).alias("initial"),
        (trimmed == "").alias("is_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("is_cut"))
    order = ["c", "live", "turn", "role", "digest"]
    sorted_ = written(
        slim.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order)
        .drop("salt").withColumn("id", F.monotonically_increasing_id()), "turns")
    seen = sorted_.where("live").groupBy("c", "role", "digest").agg(F.min("id").alias("first_seen"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    fault = (F.when(~F.col("live"), 0).when(F.col("is_blank"), 1).when(F.coalesce(F.col("id") > F.col("first_seen"), F.lit(False)), 2)
             .when(F.col("is_cut"), 3).otherwise(0))
    what = F.when(F.col("fault").isin(1, 2), DELETED).when(F.col("fault") == 3, TRUNCATED).otherwise(SOUND)
    marked = sorted_.join(seen, ["c", "role", "digest"], "left").select(
        "c", "id", F.shiftright("id", block.bit_length() - 1).alias("blk"), "turn", "initial", fault.alias("fault")).withColumn("code", (4 * what + F.col("initial")).cast("int"))
    pieces = marked.select("c", "id", "blk", "turn", "fault", "code").groupBy("blk").applyInArrow(_pieces, PIECE)
    w = Window.partitionBy("c").orderBy("blk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pieces = written(pieces.withColumns({
        "k": F.row_number().over(w).cast("long"), "of": F.count(F.lit(1)).over(Window.partitionBy("c")),
        "turn_before": F.last("last_turn", ignorenulls=True).over(before), "initial_before": F.last("last_initial", ignorenulls=True).over(before)}), "pieces")
    solved = _solve_whole(pieces.where("of = 1"), costs)
    parts = pieces.where("of > 1")
    if not parts.isEmpty():
        solved = solved.unionByName(_solve_parts(parts, costs))
    solved = written(solved, "audits")
    border = F.col("initial_before").isNull() | F.col("first_initial").isNull() | F.array_contains(
        F.lit([10 * x + y for x, y in sorted(_LEGAL)]), 10 * F.col("initial_before") + F.col("first_initial"))
    stats = pieces.groupBy("c").agg(
        (F.max("high") - F.min("low") + 1 - F.sum("turns") + F.sum(F.when(F.col("turn_before") == F.col("first_turn"), 1).otherwise(0))).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + F.sum(F.when(border, 0).otherwise(1))).alias("illegal"))
    audits = solved.groupBy("c").agg(
        F.max(F.when(F.col("k") == 1, F.col("cost"))).alias("cost"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("letters").cast("string").alias("letters")))), lambda x: x["letters"])).alias("audit"))
    summary = stats.join(audits, "c").select(
        F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).cast(kind).alias(conv), "c", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    texts = rows.where("live").select("c", "role", F.md5("text").alias("digest"), "text").dropDuplicates(["c", "role", "digest"])
    steps = _steps_of(solved)
    named = F.when(F.col("state") == ASKED, "user").otherwise("assistant")
    fetched = (steps.where("id IS NOT NULL").join(sorted_.where("live").select("id", "role", "digest"), "id").join(texts, ["c", "role", "digest"])
               .select("c", F.col("k").alias("piece"), "nr", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(named).alias("role"), "text"))
    put = steps.where("id IS NULL").select("c", F.col("k").alias("piece"), "nr", "edit", named.alias("role"), F.lit("").alias("text"))
    return Repair(summary, fetched.unionByName(put))


def digests(rows: DataFrame) -> DataFrame:
    """``c, repaired_sha256`` over ``role:text`` of the repaired rows in order, newline-joined.

    A digest is a chain: the rows of a conversation stream through one task, which holds a batch of them and the
    state of the hash. A conversation without rows gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "role", "text"))):
                if state is None or c != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = c, sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield from _table("c string, repaired_sha256 string", list(zip(*out))).to_batches()
        if state is not None:
            yield from _table("c string, repaired_sha256 string", [[now], [state.hexdigest()]]).to_batches()

    ordered = rows.select("c", "piece", "nr", "role", "text").repartition("c").sortWithinPartitions("c", "piece", "nr")
    return ordered.mapInArrow(work, "c string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows that the query repairs: ``conv_id, turn, role, text, live``; a dropped row stays as one that is not live."""
    blank = F.lit(" ")
    part = lambda name: F.coalesce(F.col(name).cast("string"), blank)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("live"), F.explode(copies).alias("_copy")).drop("_copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, with its faults, its cheapest repair and the digest of the result."""
    done = repair(damaged(table(spark, sf_dir, "conversations")), live=F.col("live"))
    empty = sha256(b"").hexdigest()
    return done.summary.join(digests(done.rows), "c", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
