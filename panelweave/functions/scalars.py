"""Row-local expressions. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands around inserted words for a moment; not a character of text.
MARK = "\x01"

# Texts that stand for "no value" in vendor files.
BLANK_TEXTS = ("NaN", "nan", "Infinity", "-Infinity", "inf", "-inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def text_to_double(c: Column) -> Column:
    """Blank, 'NaN' and infinity texts become NULL; the rest is cast, and text that is no number is NULL."""
    blank = c.rlike(r"^\s*$") | c.isin(*BLANK_TEXTS)
    return F.when(~blank, finite(c.try_cast(T.DoubleType())))


def zero_if_missing(c: Column) -> Column:
    """NULL, NaN and infinity become 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def ratio(a: Column, b: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(a, b)


def period_key(year: Column, quarter: Column) -> Column:
    """1999, 4 -> 199904."""
    return year.cast("bigint") * 100 + quarter.cast("bigint")


def period_key_text(year: Column, quarter: Column) -> Column:
    """The same key built from zero-padded text."""
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(quarter.cast("string"), 2, "0")).cast("bigint")


def linear_period(year: Column, quarter: Column) -> Column:
    """Quarters counted from 1950."""
    return (year.cast("bigint") - 1950) * 4 + quarter.cast("bigint")


def fractional_year(period: Column) -> Column:
    """199904 -> 2000.0 (year plus quarter / 4)."""
    return F.floor(period / 100).cast("double") + (period % 100).cast("double") / 4


def fiscal_quarter(month: Column) -> Column:
    """Whole thirds of the month number: January and February give 0, December gives 4."""
    return F.floor(month / 3).cast("bigint")


def date_part(date_text: Column, part: str) -> Column:
    """Year, month or day of a yyyy-mm-dd text, by position."""
    start, length = {"year": (1, 4), "month": (6, 2), "day": (9, 2)}[part]
    return F.substring(date_text, start, length).cast("bigint")


def season_sin(quarter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in (0, 1, 0, -1)]), quarter.cast("int"))


def season_cos(quarter: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in (1, 0, -1, 0)]), quarter.cast("int"))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def negative_flag(c: Column) -> Column:
    """1 for a negative value, otherwise 0 (also for NULL)."""
    return F.when(c < 0, 1).otherwise(0).cast("bigint")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    return F.lit(1.0) - F.try_divide(
        F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double")
    )


def before(c: Column, mark: str) -> Column:
    """The text before the first ``mark`` (the whole text when there is none)."""
    return F.substring_index(c, mark, 1)


#: A whole quoted string, as group 1.
QUOTED = r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')"""


def _as_json(c: Column) -> Column:
    """Python's None, True and False as JSON words; those inside quotes stay. The reader takes single quotes as they are."""
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        # Skip over whole quoted strings; replace the bare word between them.
        c = F.regexp_replace(c, QUOTED + rf"|\b{word}\b", f"$1{MARK}{json}{MARK}")
        c = F.regexp_replace(F.regexp_replace(c, f"""(["']){MARK}{json}{MARK}""", "$1"), MARK, "")
    return c


def literal_to_array(c: Column, element: str = "string") -> Column:
    """A list written as text with single or double quotes -> ARRAY; bare None, True and False are read."""
    return F.from_json(_as_json(c), f"array<{element}>")


def literal_to_map(c: Column, value: str = "string") -> Column:
    """A dict written as text with single or double quotes -> MAP; bare None, True and False are read."""
    return F.from_json(_as_json(c), f"map<string,{value}>")


def filled_count(*cols: Column) -> Column:
    """How many of ``cols`` are not NULL in this row."""
    total = F.lit(0)
    for c in cols:
        total = total + c.isNotNull().cast("int")
    return total
