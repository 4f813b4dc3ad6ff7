"""Label, percent and marker expressions over free-text cells (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells a CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Fixed patterns: loose marker test on any text; whole-field tests on the date and on the source column.
LOOSE_MARKER = r"(?i)election|voting result"
DATE_MARKER = r"(?i)^\s*(?:voting results?|election(?: results?)?)(?:\s*\[[^\]]+\])?\s*$"
SOURCE_MARKER = r"(?i)^\s*(?:(?:19|20)\d{2}\s+)?(?:general\s+)?election(?:\s*\[[^\]]+\])?\s*$"
YEAR_TOKEN = r"\b(?:19|20)\d{2}\b"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
PERCENT_CELL = r"^\s*\d{1,2}(\.\d+)?\s*%?\s*$"
# Double-encoded dash and apostrophe sequences and what they stand for.
MOJIBAKE = [("â€“", "–"), ("â€”", "—"), ("â€™", "'")]


# Characters counted as white space.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col, F.lit(WHITE_SPACE))


def missing_to_null(col: Column) -> Column:
    return F.when(~col.isin(NA_TOKENS), col)


def base_name(header: Column) -> Column:
    """CL5: header without the ``.N`` that marks a repeated name."""
    return strip(F.regexp_replace(header, r"\.\d+$", ""))


def metric_tag(header: Column) -> Column:
    """CL7: which of two metrics a group header stands for, NULL when neither."""
    h = F.lower(header)
    two_party = h.contains("2pp") | h.contains("tpp") | h.contains("two party") | h.contains("two-party")
    primary = h.contains("primary") | h.contains("first pref") | h.contains("political parties")
    return F.when(two_party, "2PP").when(primary, "Primary")


def clean_label(label: Column) -> Column:
    """CL15: lower case, without a trailing ``(metric)``, ``.N`` and ``[note]``."""
    s = F.lower(strip(label))
    for pattern in (r"\s*\([^)]*\)\s*$", r"\.\d+$", r"\[[a-z0-9]+\]$"):
        s = F.regexp_replace(s, pattern, "")
    return strip(s)


def label_and_tag(label: Column) -> tuple[Column, Column]:
    """CL20: the label part and the ``(metric)`` tag (empty string when there is none)."""
    tag = F.regexp_extract(label, r"^(?s:.*?)\s*(\([^)]*\))\s*$", 1)
    return F.when(tag != "", F.regexp_replace(label, r"\s*\([^)]*\)\s*$", "")).otherwise(label), tag


def plain_number(text: Column) -> Column:
    """A decimal number as text, else NULL; a cast alone would also take ``12d``, ``12f`` and ``0x1p3``."""
    s = strip(text)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_percent(cell: Column) -> Column:
    """CL21: number from ``'43.5%'``-like text; anything else becomes NULL."""
    return plain_number(F.regexp_replace(strip(cell), "[%–—]", ""))


def repair_mojibake(col: Column) -> Column:
    """CL22."""
    for bad, good in MOJIBAKE:
        col = F.replace(col, F.lit(bad), F.lit(good))
    return col


def has_marker(col: Column) -> Column:
    """DT19 / SC5: the text mentions a result row anywhere."""
    return F.coalesce(col.rlike(LOOSE_MARKER), F.lit(False))


def is_marker_row(date_raw: Column, pollster: Column) -> Column:
    """SC5: either text column mentions a result row."""
    return has_marker(date_raw) | has_marker(pollster)


def is_result_row(date_raw: Column, pollster: Column) -> Column:
    """SC6: one of the two fields *is* a result label, as a whole."""
    date_hit = F.coalesce(date_raw, F.lit("")).rlike(DATE_MARKER)
    source_hit = F.coalesce(pollster, F.lit("")).rlike(SOURCE_MARKER)
    return date_hit | source_hit


def marker_text(date_raw: Column, pollster: Column) -> Column:
    return F.concat(F.coalesce(date_raw, F.lit("")), F.lit(" | "), F.coalesce(pollster, F.lit("")))


def marker_relevance(text: Column, cycle: Column) -> Column:
    """SC7: does the text name this cycle, only other cycles, or none?"""
    years = F.regexp_extract_all(text, F.lit(YEAR_TOKEN), F.lit(0))
    named = F.array_contains(years, cycle.cast("string"))
    return (
        F.when(named, "explicit_current_year")
        .when(F.size(years) > 0, "historical_other_year")
        .otherwise("generic_current_candidate")
    )
