"""Inspection and sanitizing on hand-made texts, and round trips of planted ones."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstrata.operators import covert, inspect, sanitize

# (text, [(position, category, disposition)], text after the safe profile)
CASES = [
    ("plain", [], "plain"),
    ("he​llo", [(2, "zero_width", "actionable")], "hello"),
    ("🧑‍🚀", [(1, "zero_width", "informational")], "🧑‍🚀"),
    ("می‌روم", [(2, "zero_width", "informational")], "می‌روم"),
    ("﻿a﻿", [(0, "zero_width", "informational"), (2, "zero_width", "actionable")], "﻿a"),
    ("x‮y", [(1, "bidi_control", "actionable")], "xy"),
    ("ש‮y", [(1, "bidi_control", "contextual")], "ש‮y"),
    ("a️", [(1, "variation_selector", "actionable")], "a"),
    ("3️⃣", [(1, "variation_selector", "informational")], "3️⃣"),
    ("a\u00a0b", [(1, "exotic_space", "contextual")], "a b"),
    ("a\u2028b", [(1, "exotic_space", "contextual")], "a\u2028b"),
    ("pаy", [(1, "homoglyph", "actionable")], "pаy"),
    ("да", [(1, "homoglyph", "informational")], "да"),
    ("a\U000e0041", [(1, "tags_block", "actionable")], "a"),
    ("co­op", [(2, "soft_hyphen", "contextual")], "co­op"),
    (None, [], None),
    ("", [], ""),
]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_occurrences(cases):
    found = {}
    for r in inspect.occurrences(cases).orderBy("doc_id", "position").collect():
        found.setdefault(r.doc_id, []).append((r.position, r.category, r.disposition))
    assert found == {i: want for i, (_, want, _) in enumerate(CASES) if want}


def test_safe_profile(cases):
    cleaned = {r.doc_id: r.cleaned for r in sanitize.sanitize(cases).collect()}
    assert cleaned == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_edits_reverse(cases):
    edited = sanitize.apply_edits(cases, sanitize.edits(inspect.occurrences(cases)))
    restored = {r.doc_id: r.restored for r in sanitize.reverse(edited).collect()}
    assert restored == {i: text for i, (text, _, _) in enumerate(CASES)}
    forged = edited.withColumn("cleaned", F.concat("cleaned", F.lit("!")))
    assert all(r.restored is None for r in sanitize.reverse(forged).collect())


def test_aggressive_profile(spark):
    df = spark.createDataFrame([(0, "раypal­ x ﬁ")], "doc_id long, text string")
    assert sanitize.sanitize(df, "aggressive").first().cleaned == "paypal x fi"


def test_every_family_is_restored(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    report = sanitize.family_report(covert.plant(docs)).collect()
    assert len(report) == len(covert.FAMILIES) and all(r.n == r.restored for r in report)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), min_size=1, max_size=20))
def test_safe_is_idempotent(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = sanitize.sanitize(df).select("doc_id", F.col("cleaned").alias("text"))
    twice = {r.doc_id: r.cleaned for r in sanitize.sanitize(once).collect()}
    assert twice == {r.doc_id: r.text for r in once.collect()}
