"""Detectors over a closed vocabulary, and an n-gram mean score over token ids.

The vocabulary and its green tables are small and fixed, so they are literals in
the plan; texts with a word outside the vocabulary are ``unsupported``.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MULTIPLIER = 6364136223846793005
MIN_TOKENS = 32


def literal(values: Sequence, kind: str) -> Column:
    """An array literal that the optimizer folds once."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def token_ids(words: Column, vocabulary: Sequence[str]) -> Column:
    """Ids of an array of words; null for a word outside the vocabulary."""
    return F.transform(words, lambda w: F.nullif(F.array_position(literal(vocabulary, "array<string>"), w), F.lit(0)).cast("int") - 1)


def _decided(df: DataFrame, z: Column, threshold: float, minimum: int) -> DataFrame:
    unknown = F.exists("ids_", lambda i: i.isNull())
    status = (
        F.when(unknown, "unsupported")
        .when(F.col("n_") < minimum, "insufficient_evidence")
        .when(z > threshold, "detected")
        .otherwise("not_detected")
    )
    out = df.withColumn("status", status)
    scored = F.col("status").isin("detected", "not_detected")
    return (
        out.withColumn("score", F.when(scored, z))
        .withColumn("effective_tokens", F.when(F.col("status") == "unsupported", 0).otherwise(F.col("n_")))
        .drop("ids_", "pairs_", "n_", "hits_")
    )


def transition_score(
    texts: DataFrame, words: Column, vocabulary: Sequence[str], green: Sequence[Sequence[bool]], gamma: float, threshold: float = 4.0,
    minimum: int = MIN_TOKENS,
) -> DataFrame:
    """Distinct bigrams against a green table by previous and next id; strictly over the threshold is detected."""
    size = len(vocabulary)
    table = literal([int(x) for row in green for x in row], "array<int>")
    ids = texts.withColumn("ids_", token_ids(words, vocabulary))
    n = F.greatest(F.size("ids_") - 1, F.lit(0))
    codes = F.zip_with(F.slice("ids_", 1, n), F.slice("ids_", 2, n), lambda a, b: a * size + b)
    paired = ids.withColumn("pairs_", F.array_distinct(codes)).withColumn("n_", F.size("pairs_"))
    hits = paired.withColumn("hits_", F.aggregate("pairs_", F.lit(0), lambda a, p: a + F.coalesce(F.get(table, p), F.lit(0))))
    z = F.when(F.col("n_") > 0, (F.col("hits_") - gamma * F.col("n_")) / F.sqrt(F.col("n_") * gamma * (1 - gamma))).otherwise(0.0)
    return _decided(hits, z, threshold, minimum)


def mask_score(
    texts: DataFrame, words: Column, vocabulary: Sequence[str], green: Sequence[bool], fraction: float = 0.5,
    threshold: float = 2.3263478740408408, minimum: int = MIN_TOKENS,
) -> DataFrame:
    """Distinct ids against a green mask, corrected for the finite vocabulary."""
    size = len(vocabulary)
    table = literal([int(x) for x in green], "array<int>")
    ids = texts.withColumn("ids_", token_ids(words, vocabulary))
    each = ids.withColumn("pairs_", F.array_distinct("ids_")).withColumn("n_", F.size("pairs_"))
    hits = each.withColumn("hits_", F.aggregate("pairs_", F.lit(0), lambda a, p: a + F.coalesce(F.get(table, p), F.lit(0))))
    n = F.col("n_")
    left = F.greatest(F.lit(0.0), 1 - (n - 1) / (size - 1))
    raw = (F.col("hits_") - fraction * n) / F.sqrt(fraction * (1 - fraction) * n)
    z = F.when((n > 0) & (left > 0), raw / F.sqrt(left)).otherwise(0.0)
    return _decided(hits, z, threshold, minimum)


def fold(start: np.ndarray, columns: Sequence) -> np.ndarray:
    """Wrapping signed 64-bit hash fold over columns of values."""
    with np.errstate(over="ignore"):
        for c in columns:
            start = (start + c) * np.int64(MULTIPLIER) + np.int64(1)
    return start


def g_values(hashes: np.ndarray, key: int) -> np.ndarray:
    """One bit for each n-gram hash under a key."""
    value = fold(hashes, [np.int64(key)])
    for _ in range(12):
        value = fold(value, [np.int64(1)]) >> np.int64(5)
    return (value >> np.int64(30)) & np.int64(1)


def start_value(keys: Sequence[int]) -> int:
    """Where the fold begins under a set of keys."""
    return int.from_bytes(hashlib.sha256(struct.pack(f"<{len(keys)}q", *keys)).digest(), "big") % ((1 << 63) - 1)


def ngram_mean(ids: Sequence[int], keys: Sequence[int], ngram: int, history: int, eos: int) -> tuple[int, float | None]:
    """Effective tokens and mean bit of one id sequence; repeated contexts and what follows the end are masked."""
    ids = np.asarray(ids, np.int64)
    n = len(ids) - ngram + 1
    if n <= 0:
        return 0, None
    start = np.full(n, start_value(keys), np.int64)
    columns = [ids[j : j + n] for j in range(ngram)]
    context = fold(start, columns[:-1])
    hashes = fold(context, columns[-1:])
    # A context counts unless it is among the ``history`` ones before it; the first of these are zeros.
    order = np.argsort(context, kind="stable")
    again = np.flatnonzero(context[order[1:]] == context[order[:-1]])
    keep = (context != 0) | (np.arange(n) >= history)
    keep[order[again + 1]] &= order[again + 1] - order[again] > history
    ends = np.flatnonzero(ids == eos)
    if len(ends):
        keep &= np.arange(n) + ngram - 1 < ends[0]
    total = int(keep.sum())
    if not total:
        return 0, None
    return total, float(sum(g_values(hashes, k)[keep].sum() for k in keys)) / (len(keys) * total)


def with_ngram_mean(df: DataFrame, ids: str, keys: Sequence[int], ngram: int = 5, history: int = 1024, eos: int = 0) -> DataFrame:
    """Adds effective_tokens and mean_g for an array<long> column of token ids."""

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType())]))
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ngram_mean(x if x is not None else [], keys, ngram, history, eos) for x in column], columns=["n", "mean"])

    return df.withColumn("scored_", run(ids)).select(*df.columns, F.col("scored_.n").alias("effective_tokens"), F.col("scored_.mean").alias("mean_g"))


def top_attributions(tokens: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest token contributions of each document; ties by start, then end."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end"))
    return tokens.withColumn("rank", rank).where(F.col("rank") <= most)


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that begin before the one before them ends: what attribution records must not hold."""
    from pyspark.sql import Window

    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("start", "end"))
    return spans.withColumn("before_", before).where((F.col("before_") > F.col("start")) | (F.col("end") <= F.col("start"))).drop("before_")
