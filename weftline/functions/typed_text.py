"""Readings of free text as numbers, truth values and dates. All stay inside the JVM.

Each takes a string column and gives NULL for text that can't be read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as yes and no, and texts that mean "no value".
YES = ["true", "1", "1.0", "да", "yes", "есть", "имеется"]
NO = ["false", "0", "0.0", "нет", "no", "нету", "отсутствует"]
NO_VALUE = ["", "-", "–", "—", "−", "n/a", "na", "неизвестно", "не известно", "не указано", "не указан", "не указана", "нет данных", "unknown", "none", "null"]

# Every kind of blank that counts as one.
BLANKS = " \t\n\x0b\f\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u2060\u3000\ufeff"
_BLANK = r"\s\u00A0\u2000-\u200B\u202F\u2060\u3000\uFEFF"
_NUMBER = rf"^([+-]?\d+(?:[{_BLANK}]+\d+)*(?:[.,]\d+)?(?:[eE][+-]?\d+)?)[{_BLANK}]*(?:[\p{{L}}°%$€₽][^\d,;]*)?$"
_DATE = r"^(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})$"


def trimmed(c: Column) -> Column:
    """Text without outer blanks of any kind (no-break blanks too)."""
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Trimmed, lower case, ё as е: the form in which words and keys are compared."""
    return F.translate(F.lower(trimmed(c)), "ё", "е")


def has_value(c: Column) -> Column:
    """False for NULL, blank text, a dash, "n/a" and words for unknown."""
    return c.isNotNull() & ~folded(c).isin(NO_VALUE)


def read_number(c: Column) -> Column:
    """A number, maybe with a unit after it, blanks between digits, a decimal comma. Ranges, lists and words are NULL."""
    body = F.regexp_extract(trimmed(c), _NUMBER, 1)
    return F.nullif(F.translate(body, "," + BLANKS, "."), F.lit("")).try_cast("double")


def read_integer(c: Column) -> Column:
    """A whole number as bigint; a number with a fraction is NULL."""
    n = read_number(c)
    return F.when((n == F.floor(n)) & (F.abs(n) < 9e15), n.cast("long"))


def read_boolean(c: Column) -> Column:
    w = folded(c)
    return F.when(w.isin(YES), F.lit(True)).when(w.isin(NO), F.lit(False))


def read_date(c: Column) -> Column:
    """A real calendar day, year-month-day or day-month-year with -, . or / between."""
    t = trimmed(c)
    p = F.split(F.translate(t, "./", "--"), "-")
    first, second, third = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    year_first = F.length(first) == 4
    day = F.concat_ws("-", F.when(year_first, first).otherwise(third), F.lpad(second, 2, "0"), F.lpad(F.when(year_first, third).otherwise(first), 2, "0"))
    return F.when(t.rlike(_DATE), day).try_cast("date")


READERS = {"int": read_integer, "double": read_number, "boolean": read_boolean, "date": read_date, "string": trimmed}
