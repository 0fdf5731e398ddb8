"""Secret scans: single patterns, and credentials in several parts linked by an interval join."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import slices, table, text_or_empty
from spanloom.session import written

#: Base kinds as listed, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weak parts: each is ordinary text by itself.
WEAK_ID = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user_?(?:name|id)?|account(?:_?id)?|login|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{4,})""", re.A | re.I)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
NAMED_SECRET = re.compile(r"""(?:pwd|pass|passphrase|private_?key|credentials?)["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""", re.A | re.I)
ENDPOINT = re.compile(r"""(?:https?|s?ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3|ldaps?|ssh)://[^\s"'<>,;]+""", re.A)
HOST = re.compile(r"""(?:host(?:name)?|server|endpoint)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+\.[A-Za-z0-9.-]+(?::[0-9]+)?)""", re.A | re.I)
#: What begins a section: a heading, a line of dashes or the like, a name in brackets.
SECTION = re.compile(r"^(?:#{1,6}\x20.*|(?:-{3,}|={3,}|\*{3,}|_{3,})[\x20\x09\r]*|\[[A-Za-z][A-Za-z0-9_.:\x20-]*\][\x20\x09\r]*)$", re.M)

KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
#: Which part of a credential a kind is.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the single patterns, by start and then kind as listed."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Parts that count only in company; those that a base span or an earlier part overlaps are left out."""
    found = [(m.start(), m.end(), "id") for m in WEAK_ID.finditer(text)]
    found += [(m.start(), m.end(), "secret") for m in NAMED_SECRET.finditer(text)]
    found += [(m.start(), m.end(), "endpoint") for m in HOST.finditer(text)]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    found += [(m.start(), m.end(), "secret") for m in WEAK_SECRET.finditer(text) if _mixed(m[0])]
    out, taken = [], sorted((s, e) for s, e, _ in base)
    at = last = 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= last and (at == len(taken) or taken[at][0] >= e):
            out.append((s, e, kind))
            last = e
    return out


def _scopes(text: str, spans: list[tuple[int, int, str]]) -> list[int]:
    """For each span (by start) the number of its section: parts of one credential share a section."""
    out, blocks = [], [m.start() for m in SECTION.finditer(text)] if spans else []
    k = 0
    for s, _, _ in spans:
        while k < len(blocks) and blocks[k] <= s:
            k += 1
        out.append(k)
    return out


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: the key, counts and digest of the base spans, and all parts with their scopes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            rows = []
            for t in part.column("t").to_pylist():
                base = base_spans(t)
                weak = weak_spans(t, base)
                spans = sorted([*base, *weak], key=lambda x: (x[0], KINDS.index(x[2])))
                said = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
                rows.append({
                    "n_assign": sum(k == "assign" for *_, k in base), "n_access": sum(k == "access" for *_, k in base),
                    "n_hex": sum(k == "hex" for *_, k in base), "base_sha256": hashlib.sha256(said.encode()).hexdigest(), "base": said,
                    "parts": [{"start": s, "end": e, "kind": k, "scope": c} for (s, e, k), c in zip(spans, _scopes(t, spans))] if weak else []})
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("scope", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds))], names=["k", *names])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts array<struct<start: long, end: long, kind: string, scope: long>>"
    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(work, schema)


def linked_parts(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """Weak parts with a complement in their scope: an interval join of the parts of each (row, scope), by start.

    ``parts`` has ``row, scope, start, end, kind``. The nearest part of each role before and after is
    found in one ordered pass, so that a scope full of parts costs no pairs. A weak secret needs an
    identifier or an endpoint, a weak identifier a secret, an endpoint both, anywhere in the scope, or
    within ``reach`` code points if that is given. ``distance`` says how far the complement is (of two,
    the farther): the nearer, the likelier one credential.
    """
    roles = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    order = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    parts = parts.withColumn("role", roles[F.col("kind")])
    for role in ("id", "secret", "endpoint"):
        own = F.col("role") == role
        back = F.col("start") - F.max(F.when(own, F.col("end"))).over(before)
        ahead = F.min(F.when(own, F.col("start"))).over(after) - F.col("end")
        nearest = F.least(back, ahead)
        near[role] = F.when(nearest >= 0, nearest).when(nearest < 0, 0)
    own, other = F.col("kind"), lambda r: F.col(f"to_{r}")
    distance = (F.when(own == "secret", F.least(other("id"), other("endpoint"))).when(own == "id", other("secret"))
                .when((own == "endpoint") & other("id").isNotNull() & other("secret").isNotNull(), F.greatest(other("id"), other("secret"))))
    linked = parts.withColumns({f"to_{r}": c for r, c in near.items()}).withColumn("distance", distance).where("distance IS NOT NULL")
    return linked if reach is None else linked.where(F.col("distance") <= reach)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """``key, n_assign, n_access, n_hex long, base_sha256, spans string, n_linked long, linked string`` of every text.

    Offsets are code points, ends exclusive. Base spans always stay; weak parts are added where
    ``linked_parts`` finds their complement in the same section of the text, however far; ``linked`` lists
    them as ``kind:start:end:distance``. Null and empty texts have no spans: the digest is that of the
    empty string, ``linked`` is empty. An empty table gives no rows. Null keys and repeated rows keep rows of
    their own; other columns aren't carried. A very long text is read whole by its task, and the parts of
    one of its sections are sorted in one task.
    """
    # written first: a row number is then the same whenever it is read
    found = written(candidates(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    parts = found.where("size(parts) > 1").select("row", F.inline("parts"))
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    added = (linked_parts(parts, reach).groupBy("row")  # no more than one text has
             .agg(F.collect_list(F.struct("start", order[F.col("kind")].alias("by"), "end", "kind", "distance")).alias("added")))
    spelled = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("long").alias("start"), order[F.split(x, ":")[0]].alias("by"), F.split(x, ":")[2].cast("long").alias("end"),
        F.split(x, ":")[0].alias("kind"), F.lit(None).cast("long").alias("distance")))
    every = F.array_sort(F.concat(spelled, "added"))
    said = lambda spans, *names: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", *(x[n] for n in names))), ",")
    return found.drop("parts").join(added, "row", "left").select(
        F.col("k").alias(key), "n_assign", "n_access", "n_hex", "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(said(every, "kind", "start", "end")).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(said(F.array_sort("added"), "kind", "start", "end", "distance"), F.lit("")).alias("linked"))


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))
