"""Dates of validity intervals: ordinals, midpoints and the point-in-time predicate."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: the end of an open interval, and what sentinels mean.
OPEN_END, INDEFINITE = 99_999_999, "indefinite"


def date_ordinal(value: Column) -> Column:
    """ISO date text as yyyymmdd; null if null, shorter than ten characters or not digits. No calendar check."""
    digits = F.concat(F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2))
    return F.when((F.length(value) >= 10) & digits.rlike("^[0-9]{8}$"), digits.cast("int"))


def end_ordinal(end: Column, sentinel: Column) -> Column:
    """The ordinal of an interval's end: open for the indefinite sentinel, null where it is unknown."""
    return F.when(sentinel == INDEFINITE, F.lit(OPEN_END)).otherwise(date_ordinal(end))


def in_force(begin_ord: Column, end_ord: Column, is_current: Column, as_of: Column) -> Column:
    """Whether an edition answers for as_of (an ordinal); without as_of the current edition does."""
    return F.when(as_of.isNull(), is_current).otherwise(F.coalesce((begin_ord <= as_of) & (end_ord >= as_of), F.lit(False)))


def midpoint(begin: Column, end: Column) -> Column:
    """A date inside the interval; 30 days after the begin if it is open; null without begin or if inverted."""
    b, e = begin.cast("date"), end.cast("date")
    inside = F.date_add(b, F.floor(F.datediff(e, b) / 2).cast("int"))
    return F.when(b.isNull() | (e < b), F.lit(None)).when(e.isNull(), F.date_add(b, 30)).otherwise(inside).cast("string")
