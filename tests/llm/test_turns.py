import re
import zlib
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm.turns import ASSISTANT, DELETED, FAR, SOUND, START, TRUNCATED, Arcs, EditCosts, damaged, digests, op11_repair, repair, solve

REAL = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def least(rows, costs=EditCosts()):
    """Cost and audit of (initial, must go, truncated) rows, state by state, all audits compared as strings."""

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to, new = NEXT[state], (cost + costs.insert, audit + "I")
                best[to] = min(best.get(to, new), new)
        return best

    best = {"": (0, "")}
    for initial, gone, cut in rows:
        now = {}
        for state, (cost, audit) in inserted(best).items():
            arcs = [(costs.delete, "D", state)]
            if not gone:
                extra = costs.truncated if cut else 0
                arcs.append((costs.rerole + extra, "R", NEXT[state]))
                if initial == NEXT[state] or (initial == "s" and state == ""):
                    arcs.append((extra, "K", initial))
            for more, letter, to in arcs:
                new = (cost + more, audit + letter)
                now[to] = min(now.get(to, new), new)
        best = now
    best = inserted(best)
    return min(best[s] for s in ("", "a") if s in best)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        real = REAL.findall(text)
        out.append("blank" if not real else "duplicate" if (role, text) in seen else "" if real[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(conv, rows):
    """``rows``: (turn, role, text) in order."""
    kinds = faults(rows)
    cost, audit = least([(r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds)])
    out, state, at = [], "", 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(("user" if state == "u" else "assistant") + ":")
            continue
        _, role, text = rows[at]
        at += 1
        if letter == "K":
            state = role[:1]
            out.append(f"{role}:{text}")
        elif letter == "R":
            state = NEXT[state]
            out.append(("user:" if state == "u" else "assistant:") + text)
    assert at == len(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, sha256("\n".join(out).encode()).hexdigest())


def damage(table):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    md5 = __import__("hashlib").md5
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], md5(x[2].encode()).hexdigest())) for c, r in convs.items()}


CODES = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=14)


@settings(max_examples=120, deadline=None)
@given(st.lists(CODES, min_size=1, max_size=5), st.sampled_from([EditCosts(), EditCosts(1, 1, 1, 1), EditCosts(3, 2, 1, 0)]))
def test_least_audit(convs, costs):
    codes = [np.array([4 * f + i for i, f in c], np.uint8) for c in convs]
    got = solve(codes, np.ones(len(codes), bool), np.full((len(codes), 4), FAR), [[START]] * len(codes), Arcs(costs))
    ends = np.cumsum(got.sizes)
    audits = ["".join("$DIKR"[x] for x in got.letters[b - s:b])[:-1] for s, b in zip(got.sizes, ends)]
    want = [least([("suax"[i], f == DELETED, f == TRUNCATED) for i, f in c], costs) for c in convs]
    assert list(zip(got.cost.tolist(), audits)) == want


def test_ranks_tell_arcs_of_one_letter_apart():
    arcs = Arcs(EditCosts(1, 9, 9, 0))
    other = 4 * SOUND + 3
    arcs.letter[other, START, 2:4], arcs.cost[other, START, 2:4], arcs.to[other, START, 2:4] = 4, 1, (2, 3)  # R to user or to assistant
    arcs.moves = arcs._moves()
    got = solve([np.array([other, 4 * SOUND + ASSISTANT, other, other])], np.array([True]), np.full((1, 4), FAR), [[START]], arcs)
    assert "".join("$DIKR"[x] for x in got.letters) == "RKRR$" and got.states.tolist()[:4] == [2, 3, 2, 3]


def test_a_long_conversation_in_few_rounds():
    rng = np.random.default_rng(1)
    code = rng.choice(12, 40_000, p=[.02, .4, .35, .03, .01, .06, .06, .01, .01, .02, .02, .01]).astype(np.uint8)
    got = solve([code], np.array([True]), np.full((1, 4), FAR), [[START]], Arcs())
    want = least([("suax"[c % 4], c // 4 == DELETED, c // 4 == TRUNCATED) for c in code.tolist()])
    assert (int(got.cost[0]), "".join("$DIKR"[x] for x in got.letters)[:-1]) == want


def results(spark, table, **more):
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    done = repair(damaged(rows), live=F.col("live"), **more)
    got = done.summary.join(digests(done.rows), "c", "left").drop("c").fillna(sha256(b"").hexdigest(), ["repaired_sha256"])
    return sorted(map(tuple, got.collect()), key=str)


def made(seed, convs, most):
    rng = np.random.default_rng(seed)
    texts = ["Hello there.", "no end", "", "  ", "Why? ", "x", "Done!\n", None, "é.", "漢字"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    out = []
    for conv in range(convs):
        for turn in range(int(rng.integers(0, most))):
            role = roles[turn % 2] if rng.random() < .8 else roles[int(rng.integers(0, 9))]
            text = f"reply {int(rng.integers(0, 99))}." if rng.random() < .7 else texts[int(rng.integers(0, 10))]
            out.append((None if conv == 3 else conv, None if rng.random() < .03 else turn + int(rng.integers(0, 2)), role, text))
    return out


def test_like_brute_force(spark):
    table = made(1, 60, 14)
    want = sorted((brute(c, r) for c, r in damage(table).items()), key=str)
    assert results(spark, table) == want
    assert any(r[1] for r in want) and any(r[3] for r in want)


def test_pieces_like_brute_force(spark):
    table = made(2, 6, 150)
    want = sorted((brute(c, r) for c, r in damage(table).items()), key=str)
    assert results(spark, table, block=4) == want
    assert results(spark, table, block=32) == want


def test_odd_tables(spark, tmp_path):
    table = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (2, None, None, None), (None, None, None, None), (5, 1, "user", "q " * 20_000 + "?")]
    docs = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS live", "2 AS c", "3 AS k", "4 AS id", "5 AS digest")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op11_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute(c, r) for c, r in damage(table).items()), key=str)
    docs.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op11_repair(spark, f"{tmp_path}/none").count() == 0


def test_rows_are_what_the_audit_says(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "tool", "B."), (1, 3, "assistant", "C.")], "conv_id long, turn long, role string, text string")
    done = repair(rows)
    assert [(r.cost, r.audit, r.truncated, r.illegal, r.gaps) for r in done.summary.collect()] == [(3, "DRK", 0, 2, 1)]
    assert [tuple(r) for r in done.rows.orderBy("piece", "nr").select("edit", "role", "text").collect()] == [("R", "user", "B."), ("K", "assistant", "C.")]
