"""Places inside long texts: stretches by code points without reading a text from its start each time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 10
WIDTH = 1 << BITS


def blocks(text: Column) -> Column:
    """A text as an array of WIDTH code points each, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDTH}}}"), F.lit(0))


def _block(held: Column, i: Column) -> Column:
    return F.coalesce(F.get(held, i), F.lit(""))


def between(held: Column, begin: Column, end: Column) -> Column:
    """The stretch from ``begin`` up to ``end`` (from 0) of a text held as blocks; it costs a block, whatever the place."""
    first, last = F.shiftright(begin, BITS), F.shiftright(end, BITS)
    at, n = begin.bitwiseAND(WIDTH - 1), end.bitwiseAND(WIDTH - 1)
    inner = F.when(last - first > 1, F.array_join(F.slice(held, first + 2, last - first - 1), "")).otherwise("")
    apart = F.concat(F.substring(_block(held, first), at + 1, F.lit(WIDTH)), inner, F.substring(_block(held, last), F.lit(1), n))
    return F.when(first == last, F.substring(_block(held, first), at + 1, n - at)).otherwise(apart)


def rest(held: Column, begin: Column) -> Column:
    """All from ``begin`` on of a text held as blocks."""
    first, at = F.shiftright(begin, BITS), begin.bitwiseAND(WIDTH - 1)
    more = F.array_join(F.slice(held, first + 2, F.greatest(F.size(held), F.lit(1))), "")
    return F.concat(F.substring(_block(held, first), at + 1, F.lit(WIDTH)), more)
