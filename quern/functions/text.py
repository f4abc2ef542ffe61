"""Predicates and formats of text values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CSV_NAME, NULL_WORDS, NUMBER, WATCHED_WORDS


def is_blank(value: Column) -> Column:
    """Empty; white space is a value."""
    return value == ""


def is_null_word(value: Column) -> Column:
    return F.lower(value).isin(*NULL_WORDS)


def number(value: Column) -> Column:
    """The finite number that a value spells, else null."""
    parsed = F.when(value.rlike(NUMBER), value.try_cast("double"))
    return F.when(F.abs(parsed) < float("inf"), parsed)


def is_all_digits(value: Column) -> Column:
    """Digits of any script, with superscripts and subscripts."""
    return value.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]+$")


def is_path(value: Column) -> Column:
    return F.startswith(value, F.lit("/"))


def watched_words(name: Column) -> Column:
    """The watched words that a column's name holds."""
    words = F.array(*[F.lit(w) for w in WATCHED_WORDS])
    return F.filter(words, lambda w: F.contains(F.lower(name), w))


def csv_suffix(name: Column) -> Column:
    """The suffix that makes a file a CSV, as written; empty if none does."""
    return F.regexp_extract(name, CSV_NAME, 0)


def dataset_stem(name: Column) -> Column:
    return F.when(name.rlike(CSV_NAME), F.regexp_replace(name, CSV_NAME, "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def compression(name: Column) -> Column:
    """gz, bz2 or xz by the last suffix, else null."""
    found = F.regexp_extract(F.lower(name), r"\.(gz|bz2|xz)$", 1)
    return F.when(found != "", found)


def bytes_text(size: Column) -> Column:
    """26.5 MB: steps of 1024 up to TB, one decimal."""
    # ties to even, as C formats; Java's formatter rounds them up
    out = F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**k, 1))).otherwise(out)
    return out


def seconds_text(seconds: Column) -> Column:
    """45s, 3m12s, 1h04m."""
    s = F.floor(seconds).cast("long")
    minutes = F.format_string("%dm%02ds", F.floor(s / 60), s % 60)
    hours = F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, minutes).otherwise(hours)


def cut_end(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit("…"))).otherwise(value)


def cut_start(value: Column, limit: int) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.lit("..."), F.right(value, F.lit(limit - 3)))).otherwise(value)


def table_cell(value: Column) -> Column:
    """One line with single blanks and escaped bars; null is empty."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return F.replace(flat, F.lit("|"), F.lit("\\|"))


def short_type(value: Column) -> Column:
    """The last part of a type's address: sc:Text and https://schema.org/Text are Text."""
    return F.element_at(F.split(F.element_at(F.split(F.coalesce(value, F.lit("")), "/"), -1), ":"), -1)


def message_pairs(message: Column) -> Column:
    """key=value parts of a message split by bars, as a map of log.<key>; parts that are no pair are log.event. Of repeated keys the first counts."""
    parts = F.filter(F.transform(F.split(message, r"\|"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    key = lambda p: strip(F.substring_index(p, "=", 1))
    is_pair = lambda p: F.contains(p, F.lit("=")) & (key(p) != "") & ~key(p).rlike(r"(?U)\s")
    pairs = F.filter(parts, is_pair)
    entry = lambda p: F.struct(F.concat(F.lit("log."), key(p)).alias("key"), strip(F.substr(p, F.instr(p, "=") + 1)).alias("value"))
    entries = F.transform(pairs, entry)
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    events = F.filter(parts, lambda p: ~is_pair(p))
    # an event part wins over a key spelt "event"
    found = F.filter(first, lambda e: (F.size(events) == 0) | (e["key"] != "log.event"))
    with_event = F.when(F.size(events) > 0, F.concat(found, F.array(F.struct(F.lit("log.event").alias("key"), F.array_join(events, " | ").alias("value"))))).otherwise(found)
    applies = F.contains(message, F.lit("|")) & F.contains(message, F.lit("="))
    return F.when(applies, F.map_from_entries(with_event)).otherwise(F.map_from_entries(F.slice(entries, 1, 0)))
