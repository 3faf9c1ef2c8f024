"""Text expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a full whitespace strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_NOT_WORD = r"[^\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """Evaluate ``value`` once per row and hand it to ``then``."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip_ws(c) -> Column:
    """Strip every kind of leading and trailing whitespace (``trim`` only takes spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def words(c) -> Column:
    """All lower-cased words of a text, in order, repeats kept."""
    return F.filter(F.split(F.lower(_col(c)), _NOT_WORD), lambda w: w != "")


def words4(c) -> Column:
    """Words made only of ASCII letters and digits, four or more long, repeats kept."""
    return F.filter(F.split(F.lower(_col(c)), _NOT_WORD), lambda w: w.rlike("^[a-z0-9]{4,}$"))


def distinct_words4(c) -> Column:
    return F.array_distinct(words4(c))


def file_name(c) -> Column:
    """Last component of a path."""
    return F.substring_index(_col(c), "/", -1)


def has_extension(c, ext: str = ".pdf", ignore_case: bool = True) -> Column:
    c = _col(c)
    return F.lower(c).endswith(ext.lower()) if ignore_case else c.endswith(ext)
