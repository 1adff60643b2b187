"""Statistical text-mark detectors on word tokens, evidence and verification.

Tokens stay in arrays inside the row and are hashed in Arrow batches, so scoring a
corpus is one pass without a shuffle. The hash key is a parameter: scores only mean
something for text that was generated under the same key.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unicode_data as U
from ..functions.bind import let

GAMMA, THRESHOLD, MIN_TOKENS = 0.25, 4.0, 32
KEY = "public-fixture-key"
SCHEMES = ("kgw-word-v1", "unigram-word-v1", "tournament-word-v1")
UNSUPPORTED = ("vendor-production",)
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s\x1c-\x1f\x85\xa0\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def tokens(text: Column) -> Column:
    """Case-folded words (with inner apostrophes) and single punctuation characters.

    A text without a character that folds or lowers to more than one is lowered as a whole.
    """
    found = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN), F.lit(0))
    special = F.lit(r"[\x{80}-\x{10FFFF}&&[\x{130}" + U.fold_class() + "]]")
    return F.when(F.rlike(text, special), F.transform(found(text), folded)).otherwise(found(F.lower(text)))


def folded(word: Column) -> Column:
    """Full case folding; only words with a character that folds by more than its lower case are taken apart."""
    special = F.lit(f"[{U.fold_class()}]")
    table = F.create_map(*[F.lit(x) for pair in sorted(U.folds().items()) for x in pair])
    one = F.transform(F.split(word, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)))
    return F.when(F.rlike(word, special), F.array_join(one, "")).otherwise(F.lower(word))


def uniform(key: str, scheme: str, *parts: Column) -> Column:
    """A hash of the parts in (0, 1): the first 64 bits of SHA-256, in the middle of their step."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(scheme), *parts).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / F.lit(2.0**64)


MEASURES = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("n", T.IntegerType())]))
#: Drawn n-grams that a worker remembers.
REMEMBERED = 1 << 17


def first_bits(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


def green_words(codes: np.ndarray, words: list[bytes], bounds: np.ndarray, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Green words and all words of each text; each different word is hashed once."""
    green = np.array([first_bits(hashlib.sha256(prefix + w).digest()) < GAMMA * 2**64 for w in words], bool)
    return by_text(green[codes] if len(codes) else np.zeros(0, bool), bounds), np.diff(bounds)


def green_bigrams(codes: np.ndarray, words: list[bytes], bounds: np.ndarray, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Green and all distinct bigrams of each text; each different one is hashed once."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[1:] == row[:-1]
    size = max(len(words), 1)
    row, pair = row[1:][inside], codes[:-1][inside] * size + codes[1:][inside]
    order = np.lexsort((pair, row))
    row, pair = row[order], pair[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])][: len(row)]
    row, pair = row[fresh], pair[fresh]
    known, at = np.unique(pair, return_inverse=True)
    draws = (hashlib.sha256(prefix + words[p // size] + b"\x1f" + words[p % size]).digest() for p in known.tolist())
    green = np.array([first_bits(d) < GAMMA * 2**64 for d in draws], bool)
    n = len(bounds) - 1
    return np.bincount(row, weights=green[at], minlength=n), np.bincount(row, minlength=n)


def tournament_sums(codes: np.ndarray, words: list[bytes], bounds: np.ndarray, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the mean of four hash layers over the tokens from the fifth on of each text, and how many those are.

    A layer's n-gram is a stretch of the joined words.
    """
    bases = [hashlib.sha256(prefix + str(d).encode() + b"\x1f") for d in range(4)]
    seen: list[dict[bytes, int]] = [{} for _ in range(4)]
    sums = np.zeros(len(bounds) - 1)
    for k, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
        if b - a <= 4:
            continue
        own = [words[c] for c in codes[a:b].tolist()]
        line = b"\x1f".join(own)
        ends = np.cumsum([len(w) + 1 for w in own])
        begins, ends = np.r_[0, ends[:-1]].tolist(), (ends - 1)[4:].tolist()
        mean = np.zeros(len(own) - 4)
        for d in range(4):
            base, known, draws = bases[d], seen[d], []
            for x, y in zip(begins[3 - d :], ends):
                gram = line[x:y]
                draw = known.get(gram)
                if draw is None:
                    h = base.copy()
                    h.update(gram)
                    draw = known[gram] = int.from_bytes(h.digest()[:8], "big")
                draws.append(draw)
            if len(known) > REMEMBERED:
                known.clear()
            mean += (np.array(draws, np.uint64).astype(np.float64) + 0.5) / 2.0**64
        sums[k] = np.cumsum(mean / 4)[-1]
    return sums, np.maximum(np.diff(bounds) - 4, 0)


def measures(schemes: tuple[str, ...], key: str):
    """An Arrow UDF from the words of a text to (value, n) for each scheme: green hits or summed layers, and tokens that count."""
    of = {"kgw-word-v1": green_bigrams, "unigram-word-v1": green_words, "tournament-word-v1": tournament_sums}
    wanted = [(of[scheme], f"{key}\x1f{scheme}\x1f".encode()) for scheme in schemes]

    @F.arrow_udf(MEASURES)
    def run(tokens: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        held = pa.array(tokens.flatten()).dictionary_encode()
        words, codes = [w.encode() for w in held.dictionary.to_pylist()], held.indices.to_numpy().astype(np.int64)
        found = [f(codes, words, bounds, prefix) for f, prefix in wanted]
        values = np.stack([v for v, _ in found], axis=1).ravel().astype(np.float64)
        counts = np.stack([n for _, n in found], axis=1).ravel().astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(values), pa.array(counts)], names=["value", "n"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, len(wanted), dtype=np.int32)), rows)

    return run


def z_score(scheme: str, value: Column, n: Column) -> Column:
    """Distance of a measure from its mean without a mark, in standard deviations."""
    if scheme == "tournament-word-v1":
        return F.when(n > 0, (value / n - 0.5) * F.sqrt(48.0 * n)).otherwise(0.0)
    return F.when(n > 0, (value - GAMMA * n) / F.sqrt(n * GAMMA * (1 - GAMMA))).otherwise(0.0)


def status_of(score: Column, n: Column) -> Column:
    return F.when(n < MIN_TOKENS, "insufficient_evidence").when(score >= THRESHOLD, "detected").otherwise("not_detected")


def score(texts: DataFrame, scheme: str, key: str = KEY, column: str = "text") -> DataFrame:
    """Adds score (z), effective_tokens and status to each text."""
    out = texts.withColumn("measure_", F.get(measures((scheme,), key)(tokens(F.col(column))), F.lit(0)))
    out = out.withColumn("score", z_score(scheme, F.col("measure_.value"), F.col("measure_.n"))).withColumn("effective_tokens", F.col("measure_.n"))
    return out.withColumn("status", status_of(F.col("score"), F.col("effective_tokens"))).drop("measure_")


EXPONENTIAL, LEAST_GAP = "exponential-word-v1", 1e-12


def gamma_tail(n: float, t: float) -> float:
    """Chance that n exponential draws of mean 1 sum to t or more: the upper incomplete gamma ratio.

    A series below the mean, a continued fraction beyond it, both scaled by their first term in logarithms.
    """
    if not n > 0 or not t > 0:
        return 1.0
    lead = n * math.log(t) - t - math.lgamma(n)
    if t < n + 1:
        term = total = 1.0 / n
        k = n
        while term > total * 1e-17:
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1.0 - math.exp(lead) * total)
    tiny, b = 1e-300, t + 1 - n
    c, d = 1 / tiny, 1 / b
    out, i, step = d, 0, 0.0
    while abs(step - 1) > 1e-16 and i < 100_000:
        i += 1
        a = -i * (i - n)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        step = c * d
        out *= step
    return math.exp(lead) * out


@F.pandas_udf(T.DoubleType())
def gamma_survival(n: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else gamma_tail(float(a), float(b)) for a, b in zip(n, t, strict=True)], dtype="float64")


def exponential(texts: DataFrame, key: str = KEY, column: str = "text", alpha: float = 1e-4) -> DataFrame:
    """Adds the exponential statistic of each text: score, effective_tokens, p_value and status.

    A word's draw is the hash of it and the word before. Under no mark, -ln(1 - draw)
    is exponential with mean 1, so the sum over n words has a gamma distribution, whose
    tail is the p-value; the score is the mean's distance from 1 in standard deviations.
    Texts under MIN_TOKENS words are ``insufficient_evidence``; those of under two have score 0 and p-value 1.
    """

    def cost(w: Column) -> Column:
        def one(i: Column) -> Column:
            draw = uniform(key, EXPONENTIAL, F.get(w, i - 1), F.get(w, i))
            return -F.log(F.greatest(F.lit(LEAST_GAP), F.lit(1.0) - draw))

        at = F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(at).alias("n"), F.aggregate(at, F.lit(0.0), lambda s, i: s + one(i)).alias("t"))

    n, t = F.col("cost_.n"), F.col("cost_.t")
    status = F.when(n < MIN_TOKENS, "insufficient_evidence").when(F.col("p_value") <= alpha, "detected").otherwise("not_detected")
    out = texts.withColumn("cost_", let(cost, tokens(F.col(column))))
    out = out.withColumn("score", F.when(n > 0, (t / n - 1) * F.sqrt(n)).otherwise(0.0)).withColumn("effective_tokens", n)
    return out.withColumn("p_value", gamma_survival(n, t)).withColumn("status", status).drop("cost_")


@F.pandas_udf(T.DoubleType())
def normal_survival(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), na_action="ignore")


def evidence(texts: DataFrame, key: str = KEY, column: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each text and scheme, with ``unsupported`` rows for vendor names: never a score for those."""
    read = texts.select(*keys, measures(SCHEMES, key)(tokens(F.col(column))).alias("measures_"))

    def row(i: int, scheme: str) -> Column:
        value, n = (F.get("measures_", F.lit(i))[c] for c in ("value", "n"))
        z = z_score(scheme, value, n)
        return F.struct(
            F.lit(scheme).alias("scheme"), status_of(z, n).alias("status"), z.alias("score"), F.lit(THRESHOLD).alias("threshold"), n.alias("effective_tokens")
        )

    def unsupported(name: str) -> Column:
        empty = {"score": "double", "threshold": "double", "effective_tokens": "int"}
        blanks = [F.lit(None).cast(kind).alias(c) for c, kind in empty.items()]
        return F.struct(F.lit(name).alias("scheme"), F.lit("unsupported").alias("status"), *blanks)

    rows = F.array(*[row(i, scheme) for i, scheme in enumerate(SCHEMES)], *map(unsupported, UNSUPPORTED))
    return read.select(*keys, F.explode(rows).alias("row_")).select(*keys, "row_.*")


def decision_mismatch() -> Column:
    """Whether status, score and threshold contradict each other (higher means detected)."""
    decided = F.col("status").isin("detected", "not_detected")
    over = F.col("score") >= F.col("threshold")
    odd = F.col("score").isNull() | F.isnan("score") | F.col("threshold").isNull()
    return decided & (odd | (over != (F.col("status") == "detected")))


def verify(before: DataFrame, after: DataFrame, calibrated: bool, independent: bool, keys: tuple[str, ...] = ("doc_id", "scheme")) -> DataFrame:
    """Paired outcome: verified_cleared needs detected then not detected by a calibrated, independent detector."""
    b = before.select(*keys, F.col("status").alias("before"))
    a = after.select(*keys, F.col("status").alias("after"))
    decided = F.col("before").isin("detected", "not_detected") & F.col("after").isin("detected", "not_detected")
    status = (
        F.when(~decided, "not_verifiable")
        .when(F.col("after") == "detected", "residual")
        .when((F.col("before") == "detected") & F.lit(calibrated and independent), "verified_cleared")
        .otherwise("not_verifiable")
    )
    return b.join(a, list(keys)).withColumn("verification", status)


def score_unique(texts: DataFrame, scheme: str, key: str = KEY) -> DataFrame:
    """Scores each distinct text once and joins them back by digest."""
    keyed = texts.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    once = score(keyed.dropDuplicates(["text_sha256"]), scheme, key).select("text_sha256", "score", "effective_tokens", "status")
    return keyed.select("doc_id", "text_sha256").join(once, "text_sha256", "left")
