"""Text positions in bytes, identities, number strings and rewriting, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(text: Column, offset: Column, length: Column) -> Column:
    """The text of a span of UTF-8 bytes."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), offset + 1, length), "UTF-8")


def byte_offset(text: Column, token: str) -> Column:
    """Byte offset of the first occurrence of a token, null without one."""
    at = F.instr(text, token)
    return F.when(at > 0, F.octet_length(text.substr(F.lit(1), at - 1)))


def line_of(prefix: Column) -> Column:
    """1-based line on which a text that begins with ``prefix`` goes on."""
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(prefix: Column) -> Column:
    """1-based byte column after ``prefix``."""
    return F.octet_length(F.substring_index(prefix, "\n", -1)) + 1


def identity(text: Column) -> Column:
    return F.struct(F.octet_length(text).cast("long").alias("byte_length"), F.sha2(text, 256).alias("sha256"))


def less(a: Column, b: Column) -> Column:
    """Whether a decimal string of any length is the smaller number; both without leading zeros."""
    return F.struct(F.length(a), a) < F.struct(F.length(b), b)


def replace_first(text: Column, old: str, new: str) -> Column:
    """``text`` with the first occurrence of a literal replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit(new), text.substr(at + len(old), F.length(text)))).otherwise(text)


def confidence_bucket(p: Column) -> Column:
    """How far a probability is from undecided."""
    return F.when((p >= 0.85) | (p <= 0.15), "high").when((p >= 0.65) | (p <= 0.35), "medium").otherwise("low")


def active(features: Column) -> Column:
    """The features of a map that are not zero."""
    return F.map_filter(features, lambda _, v: v != 0)


def valid_file_name(name: Column) -> Column:
    return F.coalesce((F.length(name) <= 160) & name.rlike(r"^[A-Za-z0-9_.-]+\.sol$"), F.lit(False))


def valid_source(source: Column) -> Column:
    """Between 1 and 1,000,000 characters and not blank."""
    return F.coalesce(F.length(source).between(1, 1_000_000) & (F.trim(source) != ""), F.lit(False))


def family_of(file: Column) -> Column:
    return F.split_part(file, F.lit("_"), F.lit(1))


def sample_id(file: Column, rule: Column) -> Column:
    return F.concat_ws("-", F.replace(F.regexp_replace(file, r"\.sol$", ""), F.lit("_"), F.lit("-")), rule)


def utc_stamp(moment: Column) -> Column:
    """A moment as text in UTC, to the second; the session's time zone must be UTC for moments that carry one."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def name_contains(name: Column, word: str = "vuln") -> Column:
    """Whether a file's name tells of ``word``."""
    return F.coalesce(F.contains(F.lower(name), F.lit(word)), F.lit(False))
