"""Text functions, Column to Column; everything but NFKC stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.config import CHARS_PER_TOKEN, MIN_TOKEN

# Patterns that decide what is a contents line, a heading or a tag.
LINE_BREAK = r"\r\n|\n|\r"
HEADER_PREFIX = r"^#{1,6}\s+"
CONTENTS_HEADER = r"(?im)^\s*(?:#{1,6}\s+)?(table of contents|contents)\s*$"
DOT_LEADER = r"^\s*(.+?)\s*(?:[.·\x{2026}]\s*){2,}(\d{1,4})(?:-\d{1,3})?\s*$"
DASH_LEADER = r"^\s*(.+?)\s*-{2,}(\d{1,4})(?:-\d{1,3})?\s*$"
TAB_NUMBER = r"^\s*(.+?)\t+(\d{1,4})(?:-\d{1,3})?\s*$"
SPACE_TAIL = r"\s{2,}(\d{1,4})(?:-\d{1,3})?[.\s]*$"
PERMISSIVE = r"^\s*(.+?)\s+([1-9][0-9]{0,2})(?:-\d{1,3})?\s*$"
NUMBERING = r"^\s*(\d+(?:\.\d+)*)\s"
PURE_NUMERIC = r"^[\d.\s]+$"
ATX = r"^(#{1,6})\s+(.+)$"
SETEXT_1, SETEXT_2 = r"^={3,}\s*$", r"^-{3,}\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+(.+)$"
BOLD = r"^\s*\*\*(.+?)\*\*\s*$"
# every page with a heading line matches: a mark, a line under a title, a number or a star that begins a line
MAY_HEAD = r"(?m)^(?:#{1,6}\s|={3}|-{3}|\s*\d|\s*\*\*)"
FENCE = "```"
SPACES = "      ﻿"
EDGE = r"^[\s\h\x0B]+|[\s\h\x0B]+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, EDGE, "")


def is_blank(c: Column) -> Column:
    return trimmed(c) == ""


def lines(text: Column) -> Column:
    """The lines of a text; a null text has none."""
    return F.split(text, LINE_BREAK, -1)


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalized(text: Column) -> Column:
    """NFKC with every exotic space a plain one; pure ASCII never leaves the JVM, since a function is called for all
    rows whatever the condition around it."""
    exotic = text.rlike(r"[^\x00-\x7F]")
    return F.when(exotic, F.translate(_nfkc(F.when(exotic, text)), SPACES, " " * len(SPACES))).otherwise(text)


def without_header_mark(line: Column) -> Column:
    return F.regexp_replace(line, HEADER_PREFIX, "")


def without_header_marks(page: Column) -> Column:
    return F.regexp_replace(page, "(?m)" + HEADER_PREFIX, "")


def ends_in_number(line: Column) -> Column:
    """What every contents line does, with its header mark or without."""
    return line.rlike(r"\d[.\s]*$")


def leader_parts(line: Column) -> list[tuple[Column, Column, Column]]:
    """(whether it matches, title, page) of a line by dots, dashes, a tab or wide space, in that order.

    Wide space is a number behind two spaces or more, with no such gap before it; it is taken apart from the
    end, since one pattern for all of it would recurse once for each word of a long line.
    """
    ends = ends_in_number(line)
    out = [(ends & line.rlike(k), F.regexp_extract(line, k, 1), F.regexp_extract(line, k, 2)) for k in (DOT_LEADER, DASH_LEADER, TAB_NUMBER)]
    head = F.regexp_replace(F.regexp_replace(line, SPACE_TAIL, ""), r"^\s+", "")
    return [*out, (ends & line.rlike(SPACE_TAIL) & (head != "") & ~head.rlike(r"\s\s"), head, F.regexp_extract(line, SPACE_TAIL, 1))]


def has_contents_header(page: Column) -> Column:
    upper = F.upper(page)
    return F.contains(upper, F.lit("CONTENTS")) & (F.contains(upper, F.lit("TABLE OF CONTENTS")) | page.rlike(CONTENTS_HEADER))


def numbering_level(title: Column) -> Column:
    """Level by leading numbers: parts other than "0", 1 at least."""
    parts = F.split(F.regexp_extract(title, NUMBERING, 1), r"\.")
    return F.greatest(F.lit(1), F.size(F.filter(parts, lambda x: (x != "0") & (x != ""))))


def outline_level(numbers: Column) -> Column:
    """Level of a numbered heading: all its parts, zeros too."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(numbers, r"\."), lambda x: x != "")))


def tagged(number: Column, text: Column) -> Column:
    return F.concat(F.lit("<physical_index_"), number.cast("string"), F.lit(">"), text, F.lit("</physical_index_"), number.cast("string"), F.lit(">"))


def tag_number(value: Column) -> Column:
    """The page number in a tag, null without one or beyond an int."""
    return F.nullif(F.regexp_extract(value, r"<physical_index_(\d+)>", 1), F.lit("")).try_cast("int")


def structure_level(structure: Column) -> Column:
    return F.coalesce(F.regexp_count(structure, F.lit(r"\.")) + 1, F.lit(1))


def without_dot_leaders(text: Column) -> Column:
    return F.regexp_replace(text, r"\.{5,}", ": ")


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def tokenize(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, two characters or more."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda x: F.length(x) >= MIN_TOKEN)


def snake(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, "(?<=[^A-Z_])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def rendered(template: str, **values: Column) -> Column:
    """A template with {{name}} replaced, one name after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def batch_number(position: Column, size: int) -> Column:
    """Batch of a 1-based position."""
    return F.floor((position - 1) / size).cast("int")
