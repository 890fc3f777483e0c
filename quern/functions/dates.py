"""Date columns delivered as text in more than one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
DAY_FIRST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"


def parse_date(text: Column) -> Column:
    """DATE of a year-first or day/month/year string; NULL when it is no calendar date.

    NULL, empty and blank text, other notations and impossible days
    (2021-13-05, 31/02/2020) all give NULL. Never raises, also in ANSI mode.
    """
    value = F.trim(text)
    iso = F.when(value.rlike(YEAR_FIRST), F.regexp_replace(value, YEAR_FIRST, "$1-$2-$3")).when(
        value.rlike(DAY_FIRST), F.regexp_replace(value, DAY_FIRST, "$3-$2-$1")
    )
    return iso.try_cast("date")


def is_blank(text: Column) -> Column:
    """True for NULL, empty and blank text."""
    return text.isNull() | (F.trim(text) == "")


#: The same parse for the SQL side; {c} is the column.
DATE_SQL = r"""try_cast(CASE
 WHEN regexp_matches(trim({c}), '^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}$') THEN regexp_replace(trim({c}), '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})$', '\1-\2-\3')
 WHEN regexp_matches(trim({c}), '^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}$') THEN regexp_replace(trim({c}), '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})$', '\3-\2-\1')
 END AS DATE)"""
