"""Reading loosely typed text: blanks, numbers, quotas, coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no cap" in a quota cell.
UNLIMITED = ("", "0", "unlimited", "none", "inf", "infinite", "-", "na", "n/a")
# The white-space characters of Unicode and the four ASCII separators.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_NUMBER = (
    r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)
_NAMED = r"(?i)^[+-]?(inf|infinity|nan)$"
_WHOLE_LIMIT = 9.2e18


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once per row; inside a lambda nothing else shares work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """Null in place of an empty string."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def pack(texts: Column | str) -> Column:
    """An array of filled texts as one text that compares as the array does.

    A NUL ends every text but the last; NULs and the character above them in a text are escaped.
    """
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))

    items = col(texts)
    whole = F.array_join(items, "")
    plain = ~(whole.contains("\0") | whole.contains("\1"))
    return F.when(plain, F.array_join(items, "\0")).otherwise(F.array_join(F.transform(items, escaped), "\0"))


def unpack(packed: Column | str) -> Column:
    """The array of texts of `pack`."""
    def restored(c: Column) -> Column:
        return F.replace(F.replace(c, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))

    text = col(packed)
    items = F.when(text != "", F.split(text, "\0")).otherwise(F.array().cast("array<string>"))
    return F.when(text.contains("\1"), F.transform(items, restored)).otherwise(items)


def _double(c: Column) -> Column:
    text = strip(c)
    plain = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")))
    return F.coalesce(plain, F.when(text.rlike(_NAMED), text)).try_cast("double")


def coerce_float(c: Column | str) -> Column:
    number = _double(col(c))
    return F.when(~F.isnan(number), number)


def coerce_int(c: Column | str) -> Column:
    """Truncate through double; out-of-range and infinite values become null."""
    number = coerce_float(c)
    return F.when(F.abs(number) < _WHOLE_LIMIT, number).cast("bigint")


def parse_quota(c: Column | str) -> Column:
    """A positive whole cap, or null where there is none."""
    text = F.lower(strip(blank(c)))
    number = F.when(~text.isin(*UNLIMITED), coerce_int(text))
    return F.when(number > 0, number)


def fmt_coord(c: Column | str) -> Column:
    return F.when(col(c).isNull(), F.lit("")).otherwise(F.format_string("%.7f", col(c)))
