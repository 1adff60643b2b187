"""Several detectors on one pair of texts: directions, margins, contracts, held-out verification, conformance.

Evidence is a table (doc_id, detector, scheme, status, score, threshold,
operator, direction, configuration_sha256), as ``detect.evidence`` makes it and
external detectors may supply it. A registry names the detectors of a session.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect

#: Detail fields that may be shown, with the type that each must have; all others are dropped.
PUBLIC_DETAILS = {
    "configuration_sha256": "string", "score_direction": "string", "threshold_operator": "string", "tokenizer": "string",
    "p_value": "double", "z_score": "double", "green_fraction": "double", "effective_tokens": "int", "window_tokens": "int",
}
SIGNALS = "array<struct<start:int,end:int,score:double,p_value:double,threshold:double>>"


def public_details(details: Column) -> Column:
    """The allowed fields of a map of details as a struct; what does not read as its type, or is not finite, is null."""
    out = []
    for name, kind in PUBLIC_DETAILS.items():
        value = F.try_element_at(details, F.lit(name))
        if kind != "string":
            value = value.try_cast(kind)
            value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value) if kind == "double" else value
        out.append(value.alias(name))
    return F.struct(*out)


def signal_spans(spans: Column, n_chars: Column) -> Column:
    """Attributed spans that lie inside the text; scores that are not finite and chances outside 0 to 1 become null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    inside = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= n_chars))
    kept = F.transform(
        inside,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            finite(s["score"]).alias("score"),
            F.when(s["p_value"].between(0.0, 1.0), s["p_value"]).alias("p_value"),
            finite(s["threshold"]).alias("threshold"),
        ),
    )
    return F.coalesce(kept, F.array().cast(SIGNALS))


def score_direction(declared: Column, status: Column, score: Column, threshold: Column) -> Column:
    """The declared side of detection, or the one that status, score and threshold imply; null without either."""
    implied = F.when(status == "detected", F.when(score >= threshold, "higher").otherwise("lower")).when(
        status == "not_detected", F.when(score < threshold, "higher").otherwise("lower")
    )
    return F.when(declared.isin("higher", "lower"), declared).when(score.isNotNull() & threshold.isNotNull(), implied)


def detection_margin(direction: Column, score: Column, threshold: Column) -> Column:
    """Distance to the threshold, positive on the detected side."""
    return F.when(direction == "higher", score - threshold).when(direction == "lower", threshold - score)


def normalized(evidence: DataFrame) -> DataFrame:
    """Evidence with contradictions turned into ``configuration_mismatch`` and errors kept: it fails closed.

    A decided status needs a finite score and threshold that agree with it; an
    unknown status is an error. Adds ``direction`` and ``margin``.
    """
    known = ("detected", "not_detected", "insufficient_evidence", "unsupported", "detector_error", "configuration_mismatch")
    score, limit = F.col("score"), F.col("threshold")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    decided = F.col("status").isin("detected", "not_detected")
    hit = F.col("status") == "detected"
    flag = F.when(F.col("operator") == ">", score > limit).when(F.col("operator") == ">=", score >= limit)
    flag = flag.when(F.col("operator") == "<", score < limit).when(F.col("operator") == "<=", score <= limit)
    odd = decided & ~F.coalesce(finite(score) & finite(limit) & (flag == hit), F.lit(False))
    status = F.when(F.col("status").isNull() | ~F.col("status").isin(*known), "detector_error").when(odd, "configuration_mismatch")
    out = evidence.withColumn("status", status.otherwise(F.col("status")))
    out = out.withColumn("direction", score_direction(F.col("direction"), F.col("status"), score, limit))
    return out.withColumn("margin", F.when(F.col("status").isin("detected", "not_detected"), detection_margin(F.col("direction"), score, limit)))


def observe(texts: DataFrame, schemes: tuple[str, ...] = detect.SCHEMES, key: str = detect.KEY) -> DataFrame:
    """Evidence of the built-in detectors in a session's form."""
    rows = [
        detect.score(texts.select("doc_id", "text"), scheme, key).select(
            "doc_id",
            F.lit(f"reference-{scheme.split('-')[0]}").alias("detector"),
            F.lit(scheme).alias("scheme"),
            "status",
            "score",
            F.lit(detect.THRESHOLD).alias("threshold"),
            F.lit(">=").alias("operator"),
            F.lit("higher").alias("direction"),
            F.sha2(F.concat_ws("\x1f", F.lit(scheme), F.lit(key)).cast("binary"), 256).alias("configuration_sha256"),
        )
        for scheme in schemes
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def contract_bound(before: str = "b", after: str = "a") -> Column:
    """Whether two observations are of one contract and decide by it: detected before, not after."""
    b, a = (lambda c: F.col(f"{before}.{c}")), (lambda c: F.col(f"{after}.{c}"))
    same = F.lit(True)
    for c in ("scheme", "threshold", "operator", "direction", "configuration_sha256"):
        same = same & b(c).isNotNull() & (b(c) == a(c))
    upward = b("operator").isin(">", ">=")
    formed = b("operator").isin(">", ">=", "<", "<=") & (upward == (b("direction") == "higher"))
    formed &= b("configuration_sha256").rlike("^[0-9a-f]{64}$")
    return F.coalesce(same & formed & (b("status") == "detected") & (a("status") == "not_detected"), F.lit(False))


def preflight(registry: DataFrame) -> str | None:
    """Why a session cannot verify, or null; registry(detector, primary, scheme, target_sha256, configuration_sha256, calibrated, independent).

    Verifiers need the primary's scheme and target, identities of their own, and
    to be calibrated and independent.
    """
    first = F.col("primary")
    r = registry.agg(
        F.count_if(first).alias("primaries"),
        F.count_if(~first).alias("verifiers"),
        F.countDistinct("detector").alias("names"),
        F.countDistinct("configuration_sha256").alias("contracts"),
        F.countDistinct("scheme").alias("schemes"),
        F.countDistinct("target_sha256").alias("targets"),
        F.count("target_sha256").alias("bound"),
        F.count_if(~first & ~(F.col("calibrated") & F.col("independent"))).alias("unfit"),
        F.count("*").alias("n"),
    ).first()
    rules = (
        (r["primaries"] != 1, "one_primary_detector_required"),
        (not r["verifiers"], "held_out_verifier_required"),
        (r["names"] < r["n"], "verifier_identity_not_distinct"),
        (r["schemes"] != 1, "verifier_scheme_mismatch"),
        (r["bound"] < r["n"] or r["targets"] != 1, "verifier_target_not_bound"),
        (r["contracts"] < r["n"], "verifier_contract_not_distinct"),
        (r["unfit"] > 0, "verifier_not_calibrated_or_independent"),
    )
    return next((reason for broken, reason in rules if broken), None)


def verify(before: DataFrame, after: DataFrame, registry: DataFrame) -> DataFrame:
    """The outcome for each document: doc_id, verification, reason.

    The primary detector must have found its mark in the source and not in the
    candidate, by one contract, and every held-out verifier must clear likewise.
    """
    problem = preflight(registry)
    ids = before.select("doc_id").distinct()
    if problem is not None:
        return ids.select("doc_id", F.lit("not_verifiable").alias("verification"), F.lit(problem).alias("reason"))
    pairs = before.alias("b").join(after.alias("a"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.detector") == F.col("b.detector")))
    rows = pairs.select(
        F.col("b.doc_id").alias("doc_id"), F.col("b.detector").alias("detector"), F.col("b.status").alias("was"),
        F.col("a.status").alias("now"), contract_bound().alias("bound"),
    ).join(F.broadcast(registry.select("detector", "primary")), "detector")  # a registry holds a session's few detectors
    own = F.col("primary")
    outcome = (
        F.when(F.col("bound"), "verified_cleared")
        .when(F.col("now") == "detected", "residual")
        .when((F.col("was") == "detector_error") | (F.col("now") == "detector_error"), "failed")
        .otherwise("not_verifiable")
    )
    one = lambda c: F.max(F.when(own, F.col(c)))
    held = lambda s: F.count_if(~own & (F.col("outcome") == s))
    grouped = rows.withColumn("outcome", outcome).groupBy("doc_id").agg(
        one("was").alias("was"), one("now").alias("now"), one("bound").alias("bound"),
        F.count_if(~own).alias("n"), held("verified_cleared").alias("cleared"), held("residual").alias("residual"), held("failed").alias("failed"),
    )
    say = lambda status, reason: F.struct(F.lit(status).alias("verification"), F.lit(reason).alias("reason"))
    told = (
        F.when(~F.coalesce(F.col("was") == "detected", F.lit(False)), say("not_verifiable", "primary_source_not_detected"))
        .when(F.col("now") == "detected", say("residual", "primary_residual"))
        .when(F.col("now") == "detector_error", say("failed", "primary_inconclusive"))
        .when(~F.coalesce(F.col("now") == "not_detected", F.lit(False)), say("not_verifiable", "primary_inconclusive"))
        .when(~F.col("bound"), say("not_verifiable", "primary_decision_contract_mismatch"))
        .when((F.col("n") > 0) & (F.col("cleared") == F.col("n")), say("verified", None))
        .when(F.col("residual") > 0, say("residual", "held_out_residual"))
        .when(F.col("failed") > 0, say("failed", "held_out_failed"))
        .otherwise(say("not_verifiable", "held_out_inconclusive"))
    )
    return ids.join(grouped.select("doc_id", told.alias("t")), "doc_id", "left").select(
        "doc_id", F.coalesce("t.verification", F.lit("not_verifiable")).alias("verification"),
        F.when(F.col("t").isNull(), "primary_source_not_detected").otherwise(F.col("t.reason")).alias("reason"),
    )


def conformance(vectors: DataFrame, tolerance: float = 1e-12, key: str = detect.KEY) -> DataFrame:
    """Vectors with the score found and whether it conforms.

    vectors(name, scheme, text, expected_status, expected_score, expected_effective_tokens).
    Published vectors hold under their publisher's key only, so the key comes in.
    """
    parts = []
    for scheme in detect.SCHEMES:
        own = vectors.where(F.col("scheme") == scheme)
        parts.append(detect.score(own, scheme, key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    near = F.abs(F.col("score") - F.col("expected_score")) <= tolerance
    same = (F.col("status") == F.col("expected_status")) & (F.col("effective_tokens") == F.col("expected_effective_tokens"))
    out = out.select("name", "scheme", "status", "score", "effective_tokens", F.coalesce(near & same, F.lit(False)).alias("conforms"))
    unknown = vectors.where(~F.col("scheme").isin(*detect.SCHEMES)).select(
        "name", "scheme", F.lit("unsupported").alias("status"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("int").alias("effective_tokens"), F.lit(False).alias("conforms"),
    )
    return out.unionByName(unknown)


def reference_texts(spark: SparkSession, requests: list[tuple[str, str, int, int, bool]], vocabulary: list[str], key: str = detect.KEY) -> DataFrame:
    """Texts made word by word: requests (name, scheme, words, seed, marked) give name, scheme, marked, text.

    A plain text draws words by a hash of seed and position. A marked one takes,
    of eight drawn words, the one that its scheme's hash ranks best after the
    words before it. Words depend on the ones before, so a text is made in one row.
    """
    schema = "name string, scheme string, words int, seed int, marked boolean"
    made = F.pandas_udf(lambda *columns: pd.Series([_written(*row, vocabulary, key) for row in zip(*columns, strict=True)]), T.StringType())
    asked = spark.createDataFrame(requests, schema)
    return asked.select("name", "scheme", "marked", made("scheme", "words", "seed", "marked").alias("text"))


def _uniform(*parts: str) -> float:
    import hashlib

    head = hashlib.sha256("\x1f".join(parts).encode()).digest()[:8]
    return (int.from_bytes(head, "big") + 0.5) / 2.0**64


def _written(scheme: str, words: int, seed: int, marked: bool, vocabulary: list[str], key: str) -> str:
    def value(sofar: list[str], word: str) -> float:
        """Low is better."""
        if scheme == "unigram-word-v1":
            return _uniform(key, scheme, word)
        if scheme == "kgw-word-v1":
            again = any(a == sofar[-1] and b == word for a, b in zip(sofar, sofar[1:])) if sofar else False
            return (_uniform(key, scheme, sofar[-1], word) if sofar else 0.5) + again
        layers = [_uniform(key, scheme, str(d), *sofar[-d - 1 :], word) for d in range(4)] if len(sofar) >= 4 else [0.5]
        return -sum(layers) / len(layers)

    out: list[str] = []
    for i in range(words):
        draws = [vocabulary[int(_uniform(str(seed), str(i), str(j)) * len(vocabulary))] for j in range(8 if marked else 1)]
        out.append(min(draws, key=lambda w: value(out, w)))
    return " ".join(out)


def claim_problems(registry: DataFrame) -> DataFrame:
    """What a detector's entry claims without ground: detector, problem.

    Vendor schemes must not claim support, calibration needs a null protocol, a
    threshold an operator, and a hash must be one.
    """
    rules = (
        (F.col("scheme").isin(*detect.UNSUPPORTED) & (F.col("support") != "unsupported"), "vendor scheme claims support"),
        (F.col("calibrated") & F.col("null_protocol_sha256").isNull(), "calibrated without a null protocol"),
        (F.col("threshold").isNotNull() & F.col("operator").isNull(), "threshold without an operator"),
        (~F.coalesce(F.col("configuration_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "configuration is not bound"),
        (F.coalesce(F.isnan("threshold") | (F.abs("threshold") == math.inf), F.lit(False)), "threshold is not finite"),
    )
    found = F.filter(F.array(*[F.when(test, why) for test, why in rules]), lambda x: x.isNotNull())
    return registry.select("detector", F.explode(found).alias("problem"))


VECTORS = "name string, scheme string, text string, expected_status string, expected_score double, expected_effective_tokens int"


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors from JSON lines; a record that does not read as one stops the load."""
    return spark.read.schema(VECTORS).option("mode", "FAILFAST").json(path)
