import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.shards import RANKS, Feistel, ShardSettings, Tokens, load_ranks, read_slots, write_shards

needs = pytest.mark.skipif(not os.path.exists(RANKS), reason="needs the vocabulary file")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation(size):
    f = Feistel(size, "k")
    slots = f.slots(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size)) and (f.sequences(slots) == np.arange(size)).all()
    if size > 60:
        assert (slots != Feistel(size, "other").slots(np.arange(size))).any() and abs(np.corrcoef(slots, np.arange(size))[0, 1]) < 0.4


@needs
@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, odd, tmp_path, parts):
    texts = [f"text number {i} " * (i % 40) for i in range(120)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS slot", "2 AS pid", "3 AS n").coalesce(8).repartition(parts)
    s = ShardSettings(length=16, per_shard=32)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    tokens = Tokens(load_ranks(RANKS))
    stream = np.concatenate([np.array([*ids, s.end]) for ids in tokens.encode([r.text or "" for r in docs.collect()])])
    folder = str(tmp_path / "out")
    count = write_shards(docs, folder, settings=s)
    assert count == -(-len(stream) // 16)
    got = read_slots(spark, folder).collect()
    assert sorted(r.slot for r in got) == list(range(count)) and sorted(r.sequence for r in got) == list(range(count))
    back = np.concatenate([np.frombuffer(r.record, "<u2") for r in sorted(got, key=lambda r: r.sequence)])
    assert back.tolist() == [*stream.tolist(), *[s.end] * (count * 16 - len(stream))]
    cuts = np.flatnonzero(back == s.end)
    said, at = [], 0
    for c in cuts.tolist():
        said.append(tokens.coder.decode(back[at:c].tolist()))
        at = c + 1
    want = [r.text or "" for r in docs.collect()]
    assert sorted(said)[len(said) - len(want):] == sorted(want) or sorted(x for x in said if x) == sorted(x for x in want if x)
    for r in got:  # a record lies where its slot says
        shard = [f for f in os.listdir(f"{folder}/shards/shard={r.slot // 32}") if f.startswith("part")]
        assert len(shard) == 1
        with open(f"{folder}/shards/shard={r.slot // 32}/{shard[0]}", "rb") as f:
            f.seek(r.slot % 32 * s.stride)
            assert f.read(32) == r.record
    some = read_slots(spark, folder, 5, 40).collect()
    assert sorted(r.slot for r in some) == list(range(5, min(45, count)))
    assert {r.slot: r.record for r in some}.items() <= {r.slot: r.record for r in got}.items()


@needs
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", " b", "'s", "12", "é", "!?", "\u3000", "𝒳", "\n\n", " \n", "\x85", "\x1c", "\xa0x"]), max_size=14).map("".join))
def test_counts(text):
    if not TOKENS:
        TOKENS.append(Tokens(load_ranks(RANKS)))
    assert TOKENS[0].count(text) == len(TOKENS[0].encode([text])[0])
    texts = [text, "", "some words", text + " and more of it", " " + text, "x " + text + "y"]
    assert np.frombuffer(TOKENS[0].ids(pa.array(texts), [7]), "<u2").tolist() == [x for ids in TOKENS[0].encode(texts) for x in (*ids, 7)]


TOKENS = []


@needs
def test_empty_table(spark, odd, tmp_path):
    assert write_shards(odd.limit(0), str(tmp_path / "none")) == 0
