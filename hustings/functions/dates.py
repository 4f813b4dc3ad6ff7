"""Free-text poll dates as column expressions (DT1-DT22).

Every accepted form is rewritten by one regular expression into ``day<sep>month<sep>year``; a range keeps its later
end, a form without a day gets day 1, a form without a year leaves the last part empty. One split then gives the
parts. Strings that match no form keep no separator and yield NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENTITY_CYCLE
from .text import LOOSE_MARKER, WHITE_SPACE, has_marker

# Month names by their first three letters.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
SEP = "\u0001"
# Fixed patterns: accepted forms once dashes and spaces are plain, and the parts they give.
NUMERIC_FORM = (r"^(0?[1-9]|1[0-2])/(\d{1,2})/(\d{4})$", f"$2{SEP}$1{SEP}$3")
TEXT_FORMS = [
    # Month D, YYYY
    (r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", f"$2{SEP}$1{SEP}$3"),
    # D Mon [YYYY], after an optional range start D- or D Mon-; a start with a year needs an end with a year
    (
        r"^(?:\d{1,2}(?:\s+[A-Za-z]+(?:\s+\d{4}(?=-\d{1,2}\s+[A-Za-z]+\s+\d{4}$))?)?-)?"
        r"(\d{1,2})\s+([A-Za-z]+)(?:\s+(\d{4}))?$",
        f"$1{SEP}$2{SEP}$3",
    ),
    # Mon [YYYY]; a range start Mon- needs a year at the end
    (r"^(?:[A-Za-z]+-(?=[A-Za-z]+\s+\d{4}$))?([A-Za-z]+)(?:\s+(\d{4}))?$", f"1{SEP}$1{SEP}$2"),
]
# Fixed patterns: citation marks, then leading qualifiers.
CITATION = r"(?i)\[[a-z0-9]+\]"
QUALIFIER = r"(?i)^(?:(?:early|late|mid)\s+)?(?:pre-?\s*)?"
DASHES = "–—"


def plain_text(text: Column) -> Column:
    """DT6: every dash becomes ``-`` and every kind of white space a blank; the separator itself is dropped."""
    return F.translate(text, DASHES + WHITE_SPACE + SEP, "-" * len(DASHES) + " " * len(WHITE_SPACE))


def strip_noise(text: Column) -> Column:
    """DT3: citation marks and leading qualifiers."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CITATION, ""), QUALIFIER, ""))


def normalise_date_text(date_raw: Column) -> Column:
    """DT2-DT15: ``day<sep>month<sep>year`` or unmatched text."""
    text = F.trim(F.regexp_replace(F.trim(plain_text(date_raw)), LOOSE_MARKER, ""))
    text = F.regexp_replace(strip_noise(text), *NUMERIC_FORM)
    text = F.trim(F.split_part(text, F.lit("/"), F.lit(-1)))
    text = F.regexp_replace(text, " *- *", "-")
    for pattern, parts in TEXT_FORMS:
        text = F.regexp_replace(text, pattern, parts)
    return text


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps a long expression from being copied at every use."""
    return F.get(F.transform(F.array(value), use), 0)


def month_number(name: Column) -> Column:
    """DT18; a numeric month passes through."""
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    numeric = F.when(F.left(name, F.lit(1)) <= "9", name.cast("int"))
    return F.coalesce(numeric, F.try_element_at(table, F.lower(F.left(name, F.lit(3)))))


def clamped_date(year: Column, month: Column, day: Column) -> Column:
    """DT17: a day past the month's end becomes its last day; impossible parts give NULL."""
    valid = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1)
    first = F.make_date(year, month, F.lit(1))
    return F.when(valid, bind(first, lambda d: F.date_add(d, F.least(day, F.day(F.last_day(d))) - 1)))


def poll_date(date_raw: Column, cycle: Column, month_hint: Column | None = None) -> Column:
    """DT1, DT16: the date meant by a text.

    A form without a year takes the cycle's, or the year before when its month lies after ``month_hint``.
    """
    hint = F.lit(None).cast("int") if month_hint is None else month_hint

    def from_numbers(p: Column) -> Column:
        implied = F.when(cycle != 0, cycle - F.when(p["month"] > hint, 1).otherwise(0))
        return bind(F.coalesce(p["year"], implied), lambda year: clamped_date(year, p["month"], p["day"]))

    def from_parts(p: Column) -> Column:
        numbers = F.struct(
            F.get(p, 0).cast("int").alias("day"),
            month_number(F.get(p, 1)).alias("month"),
            F.when(F.get(p, 2) != "", F.get(p, 2).cast("int")).alias("year"),
        )
        return F.when(F.size(p) == 3, bind(numbers, from_numbers))

    return bind(F.split(normalise_date_text(date_raw), SEP), from_parts)


def with_poll_date(
    df: DataFrame,
    date_raw: str = "date_raw",
    cycle: str = "election_year",
    month_hint: str | None = None,
    out: str = "poll_date",
) -> DataFrame:
    """DT1, DT19: add ``poll_date`` and ``is_election_result``; ``month_hint`` names the closing-month column."""
    hint = F.col(month_hint) if month_hint else None
    return df.withColumns(
        {"is_election_result": has_marker(F.col(date_raw)), out: poll_date(F.col(date_raw), F.col(cycle), hint)}
    )


def closing_months(dated: DataFrame, order: list[str], keys: list[str] = ENTITY_CYCLE) -> DataFrame:
    """DT20: month of the first dated result row of each cycle, in the given row order."""
    marks = dated.where(F.col("is_election_result") & F.col("poll_date").isNotNull())
    return marks.groupBy(*keys).agg(F.min_by(F.month("poll_date"), F.struct(*order)).alias("closing_month"))


def with_poll_date_two_pass(
    df: DataFrame, order: list[str], keys: list[str] = ENTITY_CYCLE, known: DataFrame | None = None
) -> DataFrame:
    """DT20: parse, learn each cycle's closing month from its dated result rows, parse again with that hint.

    ``known`` holds closing months (keys, closing_month) that are certain; they win over the learned ones.
    """
    months = closing_months(with_poll_date(df), order, keys)
    if known is not None:
        sure = known.select(*keys, F.col("closing_month").alias("_known"))
        months = months.join(sure, keys, "full").select(*keys, F.coalesce("_known", "closing_month").alias("closing_month"))
    return with_poll_date(df.join(months, keys, "left"), month_hint="closing_month").drop("closing_month")


def parse_rate(dated: DataFrame, by: list[str]) -> DataFrame:
    """DT21: rows, parsed rows and rate per group."""
    return dated.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("poll_date").isNotNull()).alias("parsed"),
        (100.0 * F.count_if(F.col("poll_date").isNotNull()) / F.count("*")).alias("parsed_pct"),
    )


def unparsed_samples(dated: DataFrame, n: int = 10) -> DataFrame:
    """DT21: the first ``n`` distinct texts that gave no date (a report, so the limit is the feature)."""
    failed = dated.where(F.col("poll_date").isNull() & F.col("date_raw").isNotNull())
    return failed.select("date_raw").distinct().orderBy("date_raw").limit(n)


def iso_date(col: Column) -> Column:
    """DT22."""
    return F.date_format(col, "yyyy-MM-dd")
