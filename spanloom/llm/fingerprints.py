"""Document fingerprints by consistent weighted sampling; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import table, text_or_empty

#: Samples of a fingerprint: a likeness of 0.5 has a standard error of 0.06.
SAMPLES = 64

#: Samples drawn from one row of a term; compiled code for more of them is slower than more rows.
TOGETHER = 16

#: Text that one task works on, the buckets a task has on average, and the most buckets (a list of 128 KB).
TASK_BYTES = 8 << 20
BUCKETS_PER_TASK = 4
MOST_BUCKETS = 16_384

_ODD = (1 << 22) - 2
_TAG = (1 << 31) - 1


def _gamma(bits: Column) -> Column:
    """A draw from Gamma(2, 1): minus the logarithm of a product of two uniform numbers, odd parts of 2 ** 22 of 44 bits."""
    odd = lambda b: b.bitwiseAND(F.lit(_ODD)).bitwiseOR(F.lit(1))
    return F.lit(44 * math.log(2)) - F.log((odd(bits) * odd(F.shiftright(bits, 22))).cast("double"))


def sample(term: Column, ln_weight: Column, k: Column) -> Column:
    """Sample ``k`` of a weighted term as a number; the least over the terms of a document is the document's.

    For a term draw r and c from Gamma(2, 1) and b from (0, 1), all from hashes of term and k. With t = floor(ln
    weight / r + b) the term competes by ln c - r (t - b) - r. The winner (term, t) is the sample: two documents agree on
    it with the probability of their generalised Jaccard similarity, sum of least over sum of greatest weights. The
    number holds the competing value in steps of 2 ** -23 above 31 bits that name (term, t). Null for a null weight;
    weights between 1e-40 and 1e12 stay inside the number.
    """
    first = F.xxhash64(term, k)
    second = F.xxhash64(first)
    r, ln_c = _gamma(first), F.log(_gamma(second))
    b = F.shiftrightunsigned(first, 43).cast("double") * F.lit(2.0 ** -21)
    t = F.floor(ln_weight / r + b)
    value = F.floor((ln_c - r * (t - b + 1) + 80) * F.lit(float(1 << 23)))
    return F.shiftleft(value, 31).bitwiseOR(second.bitwiseXOR(t).bitwiseAND(F.lit(_TAG)))


def signatures(terms: DataFrame, keys: list[str], term: str, weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, under the name of each of ``weights``, an array of the samples of the group's weighted terms.

    ``term`` is a 64-bit hash, once in each group. A null weight leaves a term out; a group of which all are left out has
    a null array. Only least values are kept, so a group of any size is combined before it is moved. ``samples`` are a
    multiple of ``TOGETHER``.
    """
    parts, rest = divmod(samples, TOGETHER)
    if rest or not parts:
        raise ValueError(f"samples come in groups of {TOGETHER}")
    rows = terms.select(*keys, F.col(term).alias("_term"), *(F.log(w).alias(w) for w in weights)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(TOGETHER * (parts - 1)), F.lit(TOGETHER))).alias("_from"))
    least = [F.min(sample(F.col("_term"), F.col(w), F.col("_from") + i)).alias(f"_{w}{i}") for i in range(TOGETHER) for w in weights]
    tag = lambda c: F.col(c).bitwiseAND(F.lit(_TAG)).cast("int")
    some = [F.when(F.col(f"_{w}0").isNotNull(), F.array(*(tag(f"_{w}{i}") for i in range(TOGETHER)))).alias(w) for w in weights]
    grouped = rows.groupBy(*keys, "_from").agg(*least).select(*keys, F.struct("_from", *some).alias("_part"))
    whole = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    return whole.select(*keys, *(F.flatten(F.col("_parts")[w]).alias(w) for w in weights))


def shown(signature: Column) -> Column:
    """A fingerprint as text, eight hexadecimal digits a sample; empty for a document without terms."""
    return F.coalesce(F.concat_ws("", F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0"))), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples that agree: 1 for two documents without terms, 0 for one of them."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; an empty one at an end that is blank."""
    return F.split(text, r"[\x20\x09-\x0D]+")


def fingerprint_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``key, fingerprint`` (array of int) of every text, its words weighted by how often it has them.

    One row per key; repeated rows of a key count as one text that has all their words. Null, empty and blank texts
    have a null fingerprint, a null key is a key. Other columns are not carried. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("k"), F.explode(words(text_or_empty(text))).alias("w")).select("k", F.when(F.col("w") != "", F.xxhash64("w")).alias("term"))
    counted = rows.groupBy("k", "term").agg(F.when(F.col("term").isNotNull(), F.count(F.lit(1))).alias("n"))
    return signatures(counted, ["k"], "term", ["n"], samples).withColumnsRenamed({"k": key, "n": "fingerprint"})


def _listed(numbers: list, kind: str = "bigint") -> Column:
    """A constant array, folded from one text."""
    return F.expr(f"cast(split('{','.join(map(str, numbers))}', ',') AS array<{kind}>)")


def _place(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are less than ``value``, by halving steps."""
    if not cuts:
        return F.lit(0)
    sorted_ = _listed(cuts)
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(sorted_, at + step - 1) < value, at + step).otherwise(at))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document and the text that follows it in descending order of ``key``; after the last comes the first.

    ``bucket, at`` (bucket and place), ``border``, ``k``, ``t``, ``next_t`` and ``alone``: that no row has a key. Ranges of keys are buckets, cut at keys that exist:
    so the greatest key below a bucket is the cut itself, and its document comes along as the bucket's last row, marked
    ``border``. No window spans the table. Rows of one key are ordered by the hash of their text; rows without a key
    follow all others.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    found = rows.agg(F.max("k").alias("top"), F.sum(F.octet_length("t")).alias("bytes"), F.percentile_approx(
        "k", _listed([i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)], "double"), 8 * MOST_BUCKETS).alias("cuts")).first()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (found["bytes"] or 0) // TASK_BYTES)
    every = max(1, MOST_BUCKETS // (tasks * BUCKETS_PER_TASK))
    cuts = sorted(set((found["cuts"] or [])[every - 1::every]))
    own = F.when(F.col("k").isNull(), 0).otherwise(_place(cuts, F.col("k")))
    is_cut = F.get(_listed(cuts), F.col("own")) == F.col("k") if cuts else F.lit(False)
    put = lambda bucket, border: F.struct(bucket.cast("int").alias("bucket"), F.lit(border).alias("border"))
    places = F.filter(F.array(put(F.col("own"), False), F.when(is_cut, put(F.col("own") + 1, True)),
                              F.when(F.col("k") == F.lit(found["top"]), put(F.lit(0), True))), lambda p: p.isNotNull())
    placed = rows.withColumn("own", own).select("k", "t", F.explode(places).alias("p")).select("p.*", "k", "t", F.xxhash64("t").alias("tie")).where("bucket IS NOT NULL")
    w = Window.partitionBy("bucket").orderBy("border", F.col("k").desc_nulls_last(), "tie")
    near = placed.repartition(tasks, "bucket").withColumns({"at": F.row_number().over(w), "next_t": F.lead("t").over(w)})
    near = near.withColumn("alone", F.lit(found["top"] is None))  # no keys at all: one bucket without a border
    return near.withColumn("next_t", F.when(F.col("alone"), F.coalesce("next_t", F.first("t").over(w))).otherwise(F.col("next_t"))).drop("tie")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of the text whose second half the next document's beginning replaces, and their likeness.

    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; one row per input row. The last
    floor(n_chars / 2) code points give way to as many of the next document, or to all it has. Terms are words, weighted by
    their counts, so equal texts, and texts of the same words, have equal fingerprints.

    Null and empty texts have an empty fingerprint, and likeness 1 to one another. Repeated rows and rows of one key are
    documents of their own, see ``followed``; rows without a key share a bucket. Other columns are not carried, so none
    can clash. An empty table gives no rows. A text is moved once, into its bucket; only samples and digests are moved
    again. Memory follows the longest text and the distinct words of a task.
    """
    kind = docs.schema[key].dataType.simpleString()
    near = followed(docs, key, text)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("border"), F.concat(F.left("t", n - half), F.left("next_t", half)))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("x")), F.struct(F.lit(1).alias("which"), edited.alias("x")))
    rows = near.select("bucket", "at", F.explode(both).alias("b")).select("bucket", "at", "b.which", F.explode(words(F.col("b.x"))).alias("w"))
    count = lambda which: F.sum(F.when(F.col("which") == which, F.lit(1).cast("long")))
    counted = rows.where("w <> ''").select("bucket", "at", "which", F.xxhash64("w").alias("term")).groupBy("bucket", "at", "term").agg(
        count(0).alias("own"), count(1).alias("edited"))
    signed = signatures(counted, ["bucket", "at"], "term", ["own", "edited"], samples)
    facts = near.select("bucket", "at", "border", "alone", "k", n.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    w = Window.partitionBy("bucket").orderBy("at")
    first = F.when(F.col("alone") & F.lead("at").over(w).isNull(), F.first("own").over(w))
    joined = facts.join(signed, ["bucket", "at"], "left").withColumn("_next", F.coalesce(F.lead("own").over(w), first))
    own, other = F.col("own"), F.col("edited")
    return joined.where("NOT border").select(
        F.col("k").cast(kind).alias(key), "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(other).alias("edited_fingerprint"),
        likeness(own, other, samples).alias("near_edited"), likeness(own, F.col("_next"), samples).alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
