"""Columns that bring keys, titles and periods into one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blank, tab and non-breaking blank: what may surround a key.
KEY_BLANKS = " \t\u00a0"


def clean_key(c: Column | str) -> Column:
    """Upper-case key without surrounding blanks; null when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.btrim(c, F.lit(KEY_BLANKS))), F.lit(""))


def fold_title(c: Column | str) -> Column:
    """Upper-case title with each run of underscores and white space as one blank, trimmed; null when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.btrim(F.regexp_replace(F.upper(c), r"(?U)[_\s]+", " ")), F.lit(""))


def month_of(c: Column | str) -> Column:
    """yyyy-MM of a date or timestamp."""
    return F.date_format(c, "yyyy-MM")


def month_words(month: Column | str) -> Column:
    """'August 2024' for '2024-08'; null if it isn't a month."""
    month = F.col(month) if isinstance(month, str) else month
    return F.date_format(F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd"), "MMMM yyyy")


def words_month(words: Column | str) -> Column:
    """'2024-08' for 'August 2024'; null if it isn't a month."""
    return F.date_format(F.try_to_date(words, "MMMM yyyy"), "yyyy-MM")
