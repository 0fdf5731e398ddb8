"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

NO_CONTENT = "(no content recorded)"


def base_name(col: Column | str) -> Column:
    """Text before the first dot: ``planner.invoke`` -> ``planner``."""
    return F.substring_index(_c(col), ".", 1)


def has_suffix(col: Column | str, kind: str) -> Column:
    """``x.chat`` has suffix ``chat``."""
    return _c(col).endswith(f".{kind}")


def attr(key: str, column: str = "attrs") -> Column:
    """Value of a span attribute, NULL when the key is absent."""
    return F.col(column).getItem(key)


def text(col: Column) -> Column:
    """Absent text is the empty string."""
    return F.coalesce(col, F.lit(""))


def number_or_zero(col: Column) -> Column:
    """Anything that is not a number counts as 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def int_or_zero(col: Column) -> Column:
    return F.coalesce(F.floor(F.abs(number_or_zero(col))) * F.signum(number_or_zero(col)), F.lit(0)).cast("bigint")


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def fold_text(col: Column | str) -> Column:
    """Lower case words of letters and digits, one space between, for comparing texts."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", " "))


def short_id(prefix: str, *parts: Column) -> Column:
    """Stable id: prefix and the first 12 hex digits of sha1 over the joined parts."""
    joined = F.concat_ws("\x1f", *[text(p.cast("string")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(joined), 1, 12))


def digest(*parts: Column) -> Column:
    """sha256 over the concatenated parts."""
    return F.sha2(F.concat(*[text(p.cast("string")) for p in parts]), 256)


def session_key(session: Column, application: Column) -> Column:
    """Drop the exact ``<application>_`` prefix, else keep the last ``_`` segment."""
    prefix = F.concat(application, F.lit("_"))
    return F.when(
        (application != "") & session.startswith(prefix),
        F.substr(session, F.length(prefix) + 1),
    ).otherwise(F.substring_index(session, "_", -1))


def epoch_seconds(ts: Column) -> Column:
    """Microsecond timestamp without zone -> seconds as a double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def instant(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds (above 1e12) or ISO text -> timestamp in UTC."""
    raw = value.cast("string")
    num = raw.try_cast("double")
    seconds = F.when(num > 1e12, num / 1000).otherwise(num)
    iso = F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00"))
    return F.when(num.isNotNull(), F.timestamp_micros((seconds * 1e6).cast("bigint"))).otherwise(iso)


def nanoseconds(stamp: Column) -> Column:
    """``2024-01-01 10:00:00.123456789`` -> nanoseconds since the epoch; extra digits are cut."""
    whole = F.unix_seconds(F.to_timestamp(F.substring_index(stamp, ".", 1), "yyyy-MM-dd HH:mm:ss"))
    fraction = F.when(stamp.contains("."), F.substring_index(stamp, ".", -1)).otherwise(F.lit("0"))
    return whole * 1_000_000_000 + F.substring(F.rpad(fraction, 9, "0"), 1, 9).cast("bigint")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def sorted_text(col: Column, sep: str = ",") -> Column:
    """Array of strings as one sorted, joined text."""
    return F.array_join(F.array_sort(col), sep)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
