import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.secrets import KINDS, ROLE, base_spans, linked_parts, scan_secrets, weak_spans

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
TEXTS = ["password = hunter22", "Secret:short", 'API_KEY: "abcdef"', "AKIA" + "A" * 16 + " and AKIA1", "0" * 24 + " " + "f" * 23, "toſen: abcdefgh", "toKen=abcdefgh",
         f"client_id = app1234\n{KEY}", f"only {KEY} here", f"client_id = app1234\n\n{KEY}", f"client_id = app1234{' ' * 300}{KEY}",
         f"see https://db.example.org/x\nlogin: robot\n{KEY}", "see https://db.example.org/x", "é𝒳 password: abcdefg1",
         f"client_id = app1234\n\n# Next\n\n{KEY}", f"client_id = app1234\n[other]\n{KEY}", f"[one]\nclient_id = app1234\n{KEY}\n---\nlogin: bob1",
         f"client_id = app1234\n\nhttps://a.b/c\n\npass: hunter22", *(f"client_id = app1234{' word' * n}\n\n{KEY}" for n in (40, 100, 200, 2000))]


def base(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) > 5]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() > 19]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() > 23]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


HEADING = re.compile(r"(#{1,6} .*|-{3,}\s*|={3,}\s*|\*{3,}\s*|_{3,}\s*|\[[A-Za-z][A-Za-z0-9_.: -]*\]\s*)")


def section(text, at):
    """Headings up to the line of a place."""
    return sum(bool(HEADING.fullmatch(line)) for line in text[:(text + "\n").index("\n", at)].split("\n"))


def brute(text, reach=10 ** 9):
    """Every pair of parts."""
    own = base(text)
    weak = weak_spans(text, own)
    every = [*own, *weak]

    def near(x, role):
        return any(ROLE[y[2]] == role and y != x and max(y[0] - x[1], x[0] - y[1]) <= reach
                   and section(text, x[0]) == section(text, y[0]) for y in every)

    def stays(x):
        return {"secret": near(x, "id") or near(x, "endpoint"), "id": near(x, "secret"), "endpoint": near(x, "id") and near(x, "secret")}[x[2]]

    spans = sorted([*own, *filter(stays, weak)], key=lambda x: (x[0], KINDS.index(x[2])))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "=", ": ", '"', "secret", "abcdef1", "AKIA", "ABCDEFGHIJKLMNOP0", "0123456789abcdef", "é", "\n", " "]), max_size=14).map("".join))
def test_base_spans(text):
    assert base_spans(text) == base(text)


def test_table_like_brute_force(spark, odd):
    pieces = ["client_id = app1234", KEY, "https://a.b/c", "password = hunter22", "\n\n", " words " * 40, "login: bob1", "AKIA" + "Z" * 16, "## Part", "-----"]
    mixed = ["\n".join(pieces[(i * 7 + j * (i % 5 + 1)) % 10] for j in range(9)) for i in range(40)]
    rows = [(100 + i, t) for i, t in enumerate(TEXTS + mixed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = scan_secrets(docs.selectExpr("*", "1 AS spans", "2 AS k", "3 AS row", "4 AS parts")).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    near = {r.doc_id: r.spans for r in scan_secrets(docs, reach=200).collect()}
    assert len(got) == docs.count()
    for r in got:
        own = base(texts[r.doc_id])
        assert r.spans == brute(texts[r.doc_id]) and near[r.doc_id] == brute(texts[r.doc_id], 200)
        parts = [x.split(":") for x in r.linked.split(",") if x]
        assert len(parts) == r.n_linked and all(f"{k}:{s}:{e}" in r.spans.split(",") and int(d) >= 0 for k, s, e, d in parts)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in own).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in own) for x in KINDS[:3])
    assert sum(r.n_linked for r in got) > 20
    assert scan_secrets(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text, found", [(TEXTS[7], True), (TEXTS[8], False), (TEXTS[9], True), (TEXTS[10], True), (TEXTS[12], False),
                                         (TEXTS[14], False), (TEXTS[15], False), (TEXTS[16], True), *((x, True) for x in TEXTS[17:])])
def test_weak_parts_need_company(text, found):
    assert bool(brute(text)) == found


def test_distance_is_that_of_the_nearest_complement(spark):
    text = f"client_id = app1234{' ' * 500}{KEY} and https://a.b/c"
    row = scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.linked == f"id:0:19:500,secret:519:{519 + len(KEY)}:5,endpoint:{524 + len(KEY)}:{537 + len(KEY)}:{505 + len(KEY)}"
