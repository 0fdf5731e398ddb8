"""Line deduplication by an edit-distance join on segments; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bit_table, having_bit, table, text_or_empty
from spanloom.session import written

#: Characters counted for the filter before edit distances.
COUNTED = "etaoinsrhldcumfgpwybv 0123456789"
#: Bits of the table of segment keys, 16 MB; a clash costs a row in the shuffle.
KEY_BITS = 1 << 27


ID = ["doc", "place", "nr"]


@dataclass(frozen=True)
class LineSettings:
    """``edits``: most edits between copies. Lines from ``near_chars`` characters on are compared so,
    from ``least_chars`` on for equality; shorter ones always stay.
    """

    edits: int = 2
    least_chars: int = 12
    near_chars: int = 30


def probe_list(edits: int, own_only: bool = False) -> Column:
    """What a line looks up, as a constant array: for which length of the other line (``delta`` less than its own),
    which segment of it, and how far from the segment's place there; ``own`` marks its own segments.

    A line within ``edits`` of another holds at least one of the other's ``edits`` + 1 segments. Of its
    substrings only those can match which leave segment i at most i edits before it and ``edits`` - i
    after it. Segment -1 is the whole line.
    """
    out = [(0, -1, 0, True)]
    for delta in range(-edits, edits + 1):
        for i in range(edits + 1):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= i and abs(shift - delta) <= edits - i:
                    out.append((delta, i, shift, delta == 0 and shift == 0))
    return F.array(*(F.struct(F.lit(d).alias("delta"), F.lit(i).alias("segment"), F.lit(x).alias("shift"), F.lit(o).alias("own"))
                     for d, i, x, o in out if o or not own_only))


def keyed(lines: DataFrame, settings: LineSettings, own_only: bool = False) -> DataFrame:
    """A row ``key, own, whole`` for each thing a line looks up; segments are nearly equal, the longer ones come last."""
    count = settings.edits + 1
    c = F.col
    # of a line with a byte a character, substrings are cut out without counting characters
    lines = lines.withColumn("bytes", F.when(F.octet_length("line") == c("size"), c("line").cast("binary")))
    rows = lines.select("*", F.inline(probe_list(settings.edits, own_only))).withColumn("other", c("size") - c("delta"))
    rows = rows.withColumns({"short": F.expr(f"CAST(other DIV {count} AS INT)"), "longer": c("other") % count})
    rows = rows.withColumns({
        "at": c("short") * c("segment") + F.greatest(F.lit(0), c("segment") - count + c("longer")) + c("shift"),
        "width": c("short") + F.when(c("segment") >= F.lit(count) - c("longer"), 1).otherwise(0)})
    rows = rows.where((c("segment") < 0) | (c("size") >= settings.near_chars) & (c("at") >= 0) & (c("at") + c("width") <= c("size")))
    part = F.coalesce(F.substring("bytes", c("at") + 1, c("width")), F.substring("line", c("at") + 1, c("width")).cast("binary"))
    key = F.when(c("segment") < 0, F.xxhash64("segment", "line")).otherwise(F.xxhash64("other", "segment", part))
    return rows.select(*ID, key.alias("key"), "own", (c("segment") < 0).alias("whole"))


def letter_counts(line: Column) -> Column:
    """Two bits for each counted character, Gray-coded: an edit changes at most two bits."""
    bits = F.lit(0).cast("long")
    for k, ch in enumerate(COUNTED):
        n = F.length(line) - F.length(F.replace(line, F.lit(ch)))
        bits = bits.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).bitwiseAND(3).cast("long"), 2 * k))
    return bits


def agreeing(edits: int) -> list[int]:
    """Masks of parts of the letter counts, one more than bits in which copies may differ: copies agree in a part."""
    parts = 2 * edits + 1
    masks = [sum(3 << 2 * k for k in range(p, len(COUNTED), parts)) for p in range(parts)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def alike(left: DataFrame, right: DataFrame, edits: int, also: Column) -> DataFrame:
    """Rows of ``left`` and ``right`` of one ``key`` for which ``also`` holds and whose ``letters`` and ``l2`` differ in 2 * ``edits`` bits at most, each pair once.

    They meet by the key and a part of the counts, so that a key in many lines is cut into small groups.
    """
    masks = agreeing(edits)
    dealt = lambda rows, c: rows.select("*", F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.col(c).bitwiseAND(m).alias("counts")) for p, m in enumerate(masks)))))
    apart = F.col("letters").bitwiseXOR(F.col("l2"))
    once = F.lit(True)  # of several parts the first
    for p, m in enumerate(masks):
        once &= (F.col("part") <= p) | (apart.bitwiseAND(m) != 0)
    return dealt(left, "letters").join(dealt(right, "l2"), ["key", "part", "counts"]).where((F.bit_count(apart) <= 2 * edits) & once & also)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is ``edits`` at most, else null.

    Bit-parallel over the band: bit k of state e says that the diagonal k - ``edits`` is reached with e
    edits. A character of ``a`` moves all diagonals of all states with a few bit operations.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def closed(states: list[Column]) -> list[Column]:
        """With one more edit, a character of ``b`` more."""
        out = [states[0]]
        for e in range(1, edits + 1):
            out.append(states[e].bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(full))
        return out

    def step(acc: Column, i: Column, a: Column, b: Column) -> Column:
        same = F.lit(0)
        for k in range(width):
            # beyond either end there is no character, which is equal to none
            same = same.bitwiseOR(F.when(F.get(b, i + F.lit(k - edits)) == F.get(a, i), 1 << k).otherwise(0))
        old = [acc[f"e{e}"] for e in range(edits + 1)]
        new = [old[0].bitwiseAND(same)]
        for e in range(1, edits + 1):
            new.append(old[e].bitwiseAND(same).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
        return F.struct(*(x.alias(f"e{e}") for e, x in enumerate(closed(new))))

    start = F.struct(*(x.alias(f"e{e}") for e, x in enumerate(closed([F.lit(1 << edits)] * (edits + 1)))))

    def finish(acc: Column, a: Column, b: Column) -> Column:
        at = F.size(b) - F.size(a) + edits
        out = F.lit(None).cast("int")
        for e in range(edits, -1, -1):
            reached = F.lit(False)
            for k in range(width):
                reached |= (at == k) & (acc[f"e{e}"].bitwiseAND(1 << k) != 0)
            out = F.when(reached, F.lit(e)).otherwise(out)
        return out

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        steps = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, lambda acc, i: step(acc, i, a, b), lambda acc: finish(acc, a, b))

    # bound to a variable, the arrays are worked out once a pair, not once a character
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 0)


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, place, nr, line`` of all lines; rows of the same key and text are the same document."""
    t = text_or_empty(text)
    return docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(key), t).alias("place"), F.posexplode(F.split(t, "\n"))).toDF("doc", "place", "nr", "line")


def earlier_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: LineSettings = LineSettings()) -> DataFrame:
    """Lines that have an earlier copy: ``doc, place, nr`` and the copy's ``of_doc, of_place, of_nr``, ``edits``.

    Earlier is by key (nulls first), then hash of the text, then line number; an earlier copy counts
    even if it has an earlier copy itself. Each line is first held against the earliest line of each of
    its keys, found by a partial aggregate. Only lines that are no copy of these are joined with all
    lines of the key, with letter counts in the join condition, so that a group of copies costs no
    pairs and a segment in many lines few; they meet by parts of the counts besides. A line equal to an earlier one needs no text any more.
    """
    t = settings.edits
    lines = lines_of(docs, key, text)
    sized = lines.withColumn("size", F.length("line")).where(F.col("size") >= settings.least_chars)
    me, other = F.struct(*ID), F.struct("first.doc", "first.place", "first.nr")
    own = keyed(sized, settings, True)
    first = own.groupBy("key").agg(F.min(me).alias("first"), F.count("*").alias("n"))
    # most substrings are no line's segment; a bit table of fixed size says so before the shuffle
    rows = having_bit(keyed(sized, settings), "key", bit_table(own, "key", KEY_BITS), KEY_BITS)
    # only lines in a key with an earlier line: few of all
    met = written(rows.join(first, "key").where(me > other), "line-matches")
    sure = (met.where("whole").groupBy(*ID).agg(F.min(F.struct(F.lit(0).alias("edits"), "first")).alias("best")))
    # a line equal to an earlier one stands for nothing that the earlier one doesn't
    open_ = written(met.join(sure.select("place", "nr"), ["place", "nr"], "left_anti"), "line-open")
    ends = F.array(F.struct("place", "nr"), F.struct(F.col("first.place").alias("place"), F.col("first.nr").alias("nr")))
    wanted = open_.select(F.inline(ends)).distinct()
    texts = written(lines.select("place", "nr", "line").join(wanted, ["place", "nr"]).dropDuplicates(["place", "nr"])
                    .withColumn("letters", letter_counts(F.col("line"))), "line-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        chars = lambda c: F.split(F.col(c), "")
        both = (pairs.join(texts.select("place", "nr", F.col("line").alias("mine"), F.col("letters").alias("l1")), ["place", "nr"])
                .join(texts.select(F.col("place").alias("fp"), F.col("nr").alias("fn"), F.col("line").alias("theirs"), F.col("letters").alias("l2")),
                      (F.col("first.place") == F.col("fp")) & (F.col("first.nr") == F.col("fn"))))
        return written(
            both.where((F.bit_count(F.col("l1").bitwiseXOR(F.col("l2"))) <= 2 * t) & (F.levenshtein("mine", "theirs", t) >= 0)).withColumn("edits", banded_distance(chars("mine"), chars("theirs"), t))
            .where("edits IS NOT NULL").groupBy(*ID).agg(F.min(F.struct("edits", "first")).alias("best")), "line-copies")

    near = verified(open_.select(*ID, "first").distinct())
    rest = open_.where("n > 1").join(near.select("place", "nr"), ["place", "nr"], "left_anti")
    known = texts.select("place", "nr", "letters")
    left = rest.join(known, ["place", "nr"]).select("key", *ID, "letters")
    right = open_.where("own").join(known.withColumnRenamed("letters", "l2"), ["place", "nr"]).select("key", me.alias("first"), "l2")
    more = alike(left, right, t, me > other).select(*ID, "first").distinct()
    found = sure.unionByName(near).unionByName(verified(more))
    return found.select(*ID, F.col("best.first.doc").alias("of_doc"), F.col("best.first.place").alias("of_place"), F.col("best.first.nr").alias("of_nr"),
                        F.col("best.edits").alias("edits"))


def drop_copied_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: LineSettings = LineSettings()) -> DataFrame:
    """``docs`` without the lines that have an earlier copy, with all columns; ``n_chars``, if there, is counted anew.

    A document of which no word is left goes, unless it had none before. Null and empty texts stay as
    they are. Rows of the same key and text are treated alike.
    """
    gone = earlier_copies(docs, key, text, settings)
    bits = (gone.groupBy("place", F.shiftright("nr", 5).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, nr % 32)")).alias("bits"))
            .groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("__gone")))
    t = text_or_empty(text)
    kept = F.array_join(F.filter(F.split(t, "\n"), lambda x, i: F.coalesce(
        F.getbit(F.element_at("__gone", F.shiftright(i, 5)), i % 32), F.lit(0)) == 0), "\n")
    joined = docs.withColumn("__place", F.xxhash64(F.col(key), t)).join(bits.withColumnRenamed("place", "__place"), "__place", "left")
    joined = joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept))
    joined = joined.where(F.col("__gone").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text)))
    return joined.select(*docs.columns)


def op8_line_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with an earlier copy within two edits, and which."""
    found = earlier_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("nr").alias("line_nr"), F.col("of_doc").alias("of_doc_id"), F.col("of_nr").alias("of_line_nr"), "edits")
