"""Text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("draft", "active", "deprecated")


def strip(c: Column) -> Column:
    """Without white space at either end, in Unicode's sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def slug(c: Column) -> Column:
    """Lower case; all but ASCII letters, digits, spaces and hyphens dropped; spaces to hyphens."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 -]", "")), " +", "-")


def slug_of(s: str) -> str:
    import re

    return re.sub(" +", "-", re.sub("[^a-z0-9 -]", "", s.lower()).strip(" "))


def depth(note_id: Column) -> Column:
    """Dots in an id; 0 for root and the notes at the top."""
    return F.size(F.split(note_id, r"\.")) - 1


def upto(note_id: Column, parts: Column) -> Column:
    """The first parts of a dotted id."""
    return F.array_join(F.slice(F.split(note_id, r"\."), F.lit(1), parts), ".")


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def compact_stamp(c: Column) -> Column:
    """The 14 digits of a timestamp that begin a refinement's id."""
    return F.date_format(c, "yyyyMMddHHmmss")


def normal_list(c: Column) -> Column:
    """Items stripped, empty ones dropped."""
    return F.filter(F.transform(c, strip), lambda x: x != "")


def search_text(c: Column) -> Column:
    """Line breaks with the white space about them to one space."""
    return F.regexp_replace(c, r"(?U)\s*\n+\s*", " ")


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def content_hash(front_matter: Column, body: Column) -> Column:
    return F.sha2(F.concat(front_matter, F.lit("\0"), body), 256)


def without_code(body: Column) -> Column:
    """Fenced blocks, then inline code, blanked."""
    return F.regexp_replace(F.regexp_replace(body, "(?s)```.*?```", " "), "`[^`\n]*`", " ")


def rotation(path: Column) -> Column:
    """The least rotation of a list of ids, compared as joined by spaces."""
    turns = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.concat(F.slice(path, i, F.size(path)), F.slice(path, F.lit(1), i - 1)))
    return F.array_min(F.transform(turns, lambda t: F.struct(F.array_join(t, " ").alias("key"), t.alias("path"))))["path"]
