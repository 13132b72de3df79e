"""Column expressions for the notations that the input tables use: white space, whole numbers, dates, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space, and the four separators U+001C to U+001F.
WHITE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680\u2000\u2001"
    "\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITE_CLASS = f"[{WHITE}]"
WHOLE = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?\z"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def whole_number(c: Column) -> Column:
    """Bigint read without white space around it; null where it cannot be read."""
    t = trim_white(c)
    return F.when(t.rlike(WHOLE), t.try_cast("bigint"))


def iso_date(c: Column) -> Column:
    """Date of an exact YYYY-MM-DD that exists in the calendar, else null; year 0000 does not exist."""
    return F.when(c.rlike(ISO_DATE) & ~c.startswith("0000"), c.try_cast("date"))


def flexible_date(c: Column) -> Column:
    """Date of YYYY-MM-DD, DD.MM.YYYY or YYYYMMDD, else null."""
    dotted = F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2))
    packed = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return iso_date(
        F.when(c.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}\z"), dotted)
        .when(c.rlike(r"^[0-9]{8}\z"), packed)
        .otherwise(c)
    )
