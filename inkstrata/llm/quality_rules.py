"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio, all in DataFrame functions.

Two multinomials over ``buckets`` hashed word unigrams and bigrams are counted,
one on all documents (raw) and one on trusted documents (target). A document's
score is the mean, over its n-grams, of log target/raw: its log-likelihood ratio
normalised by length. A document is kept when no base rule fails it and its
score reaches the threshold; the threshold is the score below which lie at most
``reject_share`` of the trusted documents, read from a histogram of scores, so it
is the same on every run. Ratios are whole millionths, so sums do not depend on
their order.

The target is fitted on at most ``max_trusted`` trusted documents (those with the
least hash of their id), which bounds the broadcast; raw counts and scores cover
every document, and the threshold every trusted one: scores are kept in the
shared folder and joined with the labels, so texts are scored once.

Base rules fail texts under 50 words and texts where words in repeated 3-word
windows make up more than half. Defined results: a null text counts as empty and
fails; without trusted documents the score is 0 and only base rules decide.
Repeated rows each get a verdict, ties at the threshold are kept. Texts of any length
are judged whole; a text with repeated windows is sorted within its row. Extra columns
are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SCALE = 1_000_000


def with_words(df: DataFrame, column: str = "text") -> DataFrame:
    text = F.coalesce(F.col(column), F.lit(""))
    return df.withColumn("words_", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def features(buckets: int):
    """Bucket of each word and of each pair of neighbours; the last word pairs with nothing."""
    words = F.col("words_")
    return F.concat(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets))),
        F.zip_with(
            words,
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda w, after: F.pmod(F.xxhash64(F.lit(2), w, after), F.lit(buckets)),
        ),
    )


def base_statistics(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds the contract's base columns to a frame that has ``words_``."""
    text = F.coalesce(F.col(column), F.lit(""))
    words = F.col("words_")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    grams = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    counted = (
        df.withColumn("n_words", F.size(words).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words, "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
        .withColumn("lines_", lines)
        .withColumn("n_dup_lines", (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"))
        .withColumn("grams_", grams)
    )
    # Only texts with a repeated window are sorted.
    repeated = F.size(F.array_distinct("grams_")) < F.size("grams_")
    pairs = F.transform("grams_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = counted.withColumn("pairs_", F.when(repeated, F.sort_array(pairs)))
    sorted_ = F.col("pairs_")
    same = lambda x, j: F.coalesce(F.get(sorted_, j)["h"] == x["h"], F.lit(False))
    found = F.filter(sorted_, lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)))
    placed = ordered.withColumn("at_", F.sort_array(F.transform(found, lambda x: x["i"])))
    at = F.col("at_")
    widths = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
    covered = F.aggregate(widths, F.lit(0), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def all_trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    return all_trusted(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit(documents: DataFrame, labels: DataFrame, buckets: int, max_trusted: int, alpha: float = 1.0) -> list[int]:
    """Log ratio of each bucket in millionths; ``buckets`` numbers, whatever the input."""
    ids = trusted_ids(labels, max_trusted).withColumn("trusted", F.lit(1))
    marked = with_words(documents.select("doc_id", "text")).select("doc_id", features(buckets).alias("f"))
    marked = marked.join(F.broadcast(ids), "doc_id", "left")
    # The outer form keeps the optimizer from filtering on the array before it is built.
    counts = (
        marked.select(F.explode_outer("f").alias("bucket"), "trusted")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        if r["bucket"] is None:  # texts without words
            continue
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    total_raw, total_target = sum(raw) + alpha * buckets, sum(target) + alpha * buckets
    if not sum(target):
        return [0] * buckets
    return [
        round(SCALE * (math.log((t + alpha) / total_target) - math.log((r + alpha) / total_raw)))
        for r, t in zip(raw, target, strict=True)
    ]


def scored(documents: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds ``llr``, the mean log ratio in whole millionths (0 for a text without words)."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<bigint>")
    f = with_words(documents).withColumn("features_", features(len(ratios)))
    total = F.aggregate("features_", F.lit(0).cast("long"), lambda a, i: a + F.get(table, i.cast("int")))
    mean = F.floor(total / F.greatest(F.size("features_"), F.lit(1))).cast("long")
    return f.withColumn("llr", mean).drop("features_")


def threshold(scores: DataFrame, labels: DataFrame, reject_share: float) -> int:
    """The largest millesimal score with at most ``reject_share`` of all trusted documents below it."""
    own = scores.select("doc_id", "llr").join(all_trusted(labels).hint("merge"), "doc_id", "left_semi")
    bins = own.groupBy(F.floor(F.col("llr") / 1000).alias("bin")).count().collect()
    total, below, found = sum(r["count"] for r in bins), 0, None
    for r in sorted(bins):
        if below > reject_share * total:
            break
        found, below = r["bin"], below + r["count"]
    return -(1 << 62) if found is None else found * 1000


def judge(
    documents: DataFrame,
    labels: DataFrame,
    buckets: int = 8192,
    max_trusted: int = 20_000,
    reject_share: float = 0.002,
) -> DataFrame:
    """Base columns, ``base_failed``, ``kept`` and the score of every document."""
    ratios = fit(documents, labels, buckets, max_trusted)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = base_statistics(scored(documents.select("doc_id", "text"), ratios)).select(*base, "llr")
    out = store.shelve(out, "quality")
    least = threshold(out, labels, reject_share)
    return out.select(
        *base,
        (~F.col("base_failed") & (F.col("llr") >= least)).alias("kept"),
        (F.col("llr") / SCALE).alias("llr"),
    )


#: The base columns in DuckDB SQL.
ORACLE_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, false AS kept_though_failed FROM counts
"""
