"""Free-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text,
# plus the four ASCII information separators.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(text, F.lit(BLANKS))


def clip(text: Column, max_chars: int) -> Column:
    """The first ``max_chars`` characters."""
    return F.substring(text, 1, max_chars)


def non_empty(text: Column) -> Column:
    """True if there is any character at all; blanks count, null does not."""
    return F.coalesce(F.length(text) > 0, F.lit(False))
