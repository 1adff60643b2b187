"""Strict JSON records and the registry of detectors."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not a JSON number")


def strict(text: str) -> object:
    """A JSON value; duplicate keys, NaN and infinities are refused."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse)


def finite(value: object) -> object:
    """Non-finite numbers become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    return [finite(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted compact form of strict JSON; null for text that is not."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(finite(strict(x)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(one)


#: Text in which JVM and Python may print a value in different ways: fractions and exponents, long numbers, escaped or
#: astral characters.
UNLIKE = r"[0-9][.eE]|[0-9]{18}|\\\\u|[\x{10000}-\x{10FFFF}]"


def canonical(text: Column) -> Column:
    """``canonical_json`` in the JVM, by way of a variant, which sorts keys and refuses repeated ones and NaN.

    The parser stops at the end of the first value; inside an array and inside an object,
    nothing else can follow it. Only texts like UNLIKE go to Python.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    listed = F.to_json(F.when(alone, inside))
    plain = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.when(text.rlike(UNLIKE), canonical_json(F.when(text.rlike(UNLIKE), text))).otherwise(plain)


Detector = Callable[[DataFrame], DataFrame]
_registry: dict[str, tuple[Detector, dict[str, str]]] = {}


def register(name: str, detector: Detector, scheme: str, replace: bool = False, **facts: str) -> None:
    """Add a detector, a function from texts(doc_id, text) to evidence rows."""
    if name in _registry and not replace:
        raise ValueError(f"detector {name} is registered already")
    _registry[name] = (detector, {"scheme": scheme} | facts)


def resolve(name: str) -> Detector:
    return _registry[name][0]


def facts(name: str) -> dict[str, str]:
    """What was declared of a detector."""
    return dict(_registry[name][1])


def names() -> list[str]:
    return sorted(_registry)


def capabilities(spark: SparkSession) -> DataFrame:
    """One row for each registered detector."""
    rows = [(name, facts["scheme"], facts.get("calibrated", "false")) for name, (_, facts) in sorted(_registry.items())]
    return spark.createDataFrame(rows, "detector string, scheme string, calibrated string")


for _scheme in detect.SCHEMES:
    register(f"reference-{_scheme.split('-')[0]}", lambda df, s=_scheme: detect.score(df, s), _scheme)
