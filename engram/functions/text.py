"""Text and id normalisation as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space, with the zero-width ones that act alike.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def norm(c: Column | str) -> Column:
    """Stripped and lower-cased."""
    return F.lower(strip(c))


def norm_id(c: Column | str) -> Column:
    """An id for comparison: stripped, lower-cased, null where blank."""
    return F.nullif(norm(c), F.lit(""))
