"""Columns from paths and file names: class, unit, index, integer fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword -> class, in the order in which they are tried.
KEYWORDS = (("drone", "drone"), ("uav", "drone"), ("dron", "drone"), ("car", "car"), ("vehic", "car"), ("coche", "car"), ("people", "person"), ("pedestr", "person"), ("person", "person"), ("human", "person"))


def class_of(name: Column, keywords: tuple[tuple[str, str], ...] = KEYWORDS) -> Column:
    """The class of the first keyword that the lower-case name contains; else null."""
    low, out = F.lower(name), F
    for word, label in keywords:
        out = out.when(low.contains(word), label)
    return out


def short_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unit_of(name: Column) -> Column:
    """The leading HH-MM of a folder name, else the whole name."""
    found = F.regexp_extract(short_name(name), r"^(\d{1,2}-\d{2})", 1)
    return F.when(found != "", found).otherwise(short_name(name))


def numbers(name: Column) -> Column:
    """All integer fields of a name; those beyond 64 bits are null in their place."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("long"))


def last_number(name: Column) -> Column:
    """The last integer of a name; null if it has none, or one beyond 64 bits."""
    found = numbers(name)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def skeleton(name: Column) -> Column:
    return F.regexp_replace(name, r"\d+", "#")


def number_order(name: Column) -> Column:
    """A struct that sorts names by their last integer, whatever its size, then by name; names without one come as 0."""
    digits = F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), F.lit(-1)), F.lit("0")), r"^0+(?=\d)", "")
    return F.struct(F.length(digits).alias("size"), digits.alias("digits"), name.alias("name"))


#: What a part of a name may look like, and the pattern it is found by.
TOKEN_PATTERNS = {"integer_runs": r"(\d+)", "date_like": r"(20\d{2}[-_]?\d{2}[-_]?\d{2})", "time_like": r"(\d{2}[-_:]\d{2}[-_:]\d{2})", "keyword_run": r"(?i)\b(run|pass|seq|session|track|meas|flight|trial)[-_]?(\d+)"}


def first_token(name: Column, pattern: str) -> Column:
    """The first match of a token pattern in a name; null without one."""
    found = F.regexp_extract(name, TOKEN_PATTERNS[pattern], 0)
    return F.when(found != "", found)


def unit_key(cls: Column, name: Column) -> Column:
    """class/name of a unit; the name may hold further slashes."""
    return F.concat_ws("/", cls, name)


def split_key(key: Column) -> tuple[Column, Column]:
    """Class and name of a unit's key, split at the first slash; without one the class is null."""
    parts = F.split(key, "/", 2)
    return F.when(F.size(parts) == 2, parts[0]), F.element_at(parts, -1)
