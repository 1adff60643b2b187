"""Local names inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each computed once a row even where lambdas use it for every element."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), F.lit(0))
