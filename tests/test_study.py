"""Sessions, studies, edits, jobs, bundles and the engine object on small fixtures."""

import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkstrata import engine
from inkstrata.functions import unicode_data as U
from inkstrata.operators import (
    bundles,
    detect,
    evaluation,
    gates,
    intervals,
    jobs,
    localize,
    metrics,
    quality,
    removal,
    sanitize,
    scan,
    session,
    spans,
    strategies,
)

TEXTS = "doc_id long, text string"


# Unicode -------------------------------------------------------------------------------------


def test_folding_is_pythons(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁre", "İstanbul", "ŉ", "ẞ", "Ꭰ", "plain", "ǰ", "ΐ", "Kelvin", "ſ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.f for r in df.select("w", detect.folded(F.col("w")).alias("f")).collect()}
    assert got == {w: w.casefold() for w in words}


def test_confusables_from_a_file(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("﻿# head\n0430 ;\t0061 ;\tMA\t# a\nFF41 ; 0061 ; MA # fullwidth decomposes\n1D00 0301 ; 0061 ; MA\n2018 ; 0027 ; MA\n00C6 ; 0041 0045 ; MA\n")
    try:
        assert U.use_confusables(str(path)) == 3
        assert U.confusables() == {"а": "a", "‘": "'", "Æ": "AE"}
        assert [r[0] for r in U.flagged_table() if r[1] == "homoglyph"] == ["а", "Æ"]
    finally:
        U.use_confusables(None)
    assert U.confusables()["×"] == "x" and U.name_of("​") == "ZERO WIDTH SPACE" and U.name_of("\U000e0000").startswith("<unassigned")


def test_manifest_and_its_reversal(spark):
    rng = random.Random(3)
    marks = ["​", "é", " ", "а", "ﬁ", "’", "½", "x", " ", "Ạ̊", "\U0001f600", "한", "가", "﻿", "Ａ"]
    rows = [(i, "".join(rng.choices(marks + list("abc "), k=rng.randint(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(rows, TEXTS)
    for profile, form in (("safe", "NFC"), ("aggressive", "NFKC")):
        out = sanitize.sanitize_with_edits(df, profile).cache()
        plain = {r.doc_id: r.cleaned for r in sanitize.sanitize(df, profile).collect()}
        for r in out.collect():
            assert r.cleaned == plain[r.doc_id]
            policy = [e for e in r.edits if e.stage == "policy"]
            assert sum(n for k, n in r.counts.items() if k != "homoglyph") == len(policy)
            assert {e.stage for e in r.edits} <= {"policy", form, "confusable_skeleton"}
        back = {r.doc_id: r.restored for r in sanitize.reverse_edits(out).collect()}
        assert back == dict(rows)
        tampered = out.withColumn("cleaned", F.concat("cleaned", F.lit("!")))
        assert sanitize.reverse_edits(tampered).where("restored is not null").count() == 0
        out.unpersist()


# Sessions ------------------------------------------------------------------------------------


def evidence(spark, rows):
    full = [(d, n, "s", st, sc, 4.0, ">=", None, c * 64) for d, n, st, sc, c in rows]
    return session.normalized(
        spark.createDataFrame(
            full, "doc_id long, detector string, scheme string, status string, score double, threshold double, operator string, direction string, configuration_sha256 string"
        )
    )


def test_held_out_verification(spark):
    registry = [("p", True, "s", "t", "a", True, True), ("v", False, "s", "t", "b", True, True)]
    schema = "detector string, primary boolean, scheme string, target_sha256 string, configuration_sha256 string, calibrated boolean, independent boolean"
    reg = spark.createDataFrame(registry, schema)
    hit, miss = ("detected", 5.0), ("not_detected", 1.0)
    cases = {  # primary before, after, verifier before, after
        1: (hit, miss, hit, miss, "verified", None),
        2: (hit, hit, hit, miss, "residual", "primary_residual"),
        3: (miss, miss, hit, miss, "not_verifiable", "primary_source_not_detected"),
        4: (hit, miss, hit, hit, "residual", "held_out_residual"),
        5: (hit, miss, miss, miss, "not_verifiable", "held_out_inconclusive"),
        6: (hit, miss, hit, ("detector_error", None), "failed", "held_out_failed"),
        7: (hit, ("detector_error", None), hit, miss, "failed", "primary_inconclusive"),
        8: (hit, ("not_detected", 9.0), hit, miss, "not_verifiable", "primary_inconclusive"),  # a contradiction
    }
    before = [(i, n, *c[k], x) for i, c in cases.items() for n, k, x in (("p", 0, "a"), ("v", 2, "b"))]
    after = [(i, n, *c[k], x) for i, c in cases.items() for n, k, x in (("p", 1, "a"), ("v", 3, "b"))]
    out = session.verify(evidence(spark, before), evidence(spark, after), reg).collect()
    assert {r.doc_id: (r.verification, r.reason) for r in out} == {i: c[4:] for i, c in cases.items()}
    for broken, reason in (
        (reg.where("primary"), "held_out_verifier_required"),
        (reg.withColumn("target_sha256", F.col("detector")), "verifier_target_not_bound"),
        (reg.withColumn("configuration_sha256", F.lit("a")), "verifier_contract_not_distinct"),
        (reg.withColumn("calibrated", F.col("primary")), "verifier_not_calibrated_or_independent"),
        (reg.withColumn("scheme", F.col("detector")), "verifier_scheme_mismatch"),
        (reg.withColumn("primary", F.lit(False)), "one_primary_detector_required"),
    ):
        assert session.preflight(broken) == reason
    assert {r.reason for r in session.verify(evidence(spark, before), evidence(spark, after), reg.where("primary")).collect()} == {"held_out_verifier_required"}


def test_generated_texts_conform(spark):
    words = [f"word{i}" for i in range(300)]
    asks = [(f"{s}-{m}", s, 120, seed, m) for s in detect.SCHEMES for seed, m in ((11, True), (29, False))]
    made = session.reference_texts(spark, asks, words)
    texts = made.collect()
    assert all(len(r.text.split()) == 120 for r in texts)
    again = session.reference_texts(spark, asks, words).collect()
    assert texts == again
    vectors = []
    for r in texts:
        got = detect.score(spark.createDataFrame([(1, r.text)], TEXTS), r.scheme).first()
        assert (got.status == "detected") == r.marked, (r.name, got.score)
        vectors.append((r.name, r.scheme, r.text, got.status, got.score, got.effective_tokens))
    vectors += [("off", vectors[0][1], vectors[0][2], "detected", vectors[0][4] + 1e-6, vectors[0][5]), ("vendor", "vendor-production", "x", "detected", 1.0, 1)]
    schema = "name string, scheme string, text string, expected_status string, expected_score double, expected_effective_tokens int"
    told = {r.name: r.conforms for r in session.conformance(spark.createDataFrame(vectors, schema)).collect()}
    assert [n for n, ok in told.items() if not ok] == ["off", "vendor"] or {n for n, ok in told.items() if not ok} == {"off", "vendor"}


def test_details_spans_and_claims(spark):
    df = spark.createDataFrame([({"z_score": "1.5", "p_value": "NaN", "effective_tokens": "x", "text": "private", "tokenizer": "w"},)], "d map<string,string>")
    got = df.select(session.public_details(F.col("d")).alias("p")).first().p.asDict()
    assert got["z_score"] == 1.5 and got["p_value"] is None and got["effective_tokens"] is None and got["tokenizer"] == "w" and "text" not in got
    spans_ = [(0, 3, 1.0, 0.5, 2.0), (2, 9, float("nan"), 1.5, None), (4, 4, 1.0, 0.1, 1.0), (-1, 2, 1.0, 0.1, 1.0)]
    df = spark.createDataFrame([(spans_, 8), (None, 8)], f"s {session.SIGNALS}, n int")
    got = [r[0] for r in df.select(session.signal_spans(F.col("s"), F.col("n"))).collect()]
    assert [tuple(x) for x in got[0]] == [(0, 3, 1.0, 0.5, 2.0)] and got[1] == []
    rows = [("ok", "s", "reference", True, "n", 1.0, ">", "a" * 64), ("bad", "vendor-production", "supported", True, None, float("inf"), None, "x")]
    reg = spark.createDataFrame(rows, "detector string, scheme string, support string, calibrated boolean, null_protocol_sha256 string, threshold double, operator string, configuration_sha256 string")
    assert {(r.detector) for r in session.claim_problems(reg).collect()} == {"bad"} and session.claim_problems(reg).count() == 5


def test_localization_refuses(spark):
    df = spark.createDataFrame([(1, "MARK " * 1000), (2, "none"), (3, "MARK")], TEXTS)
    found = localize.contains_detector("MARK")
    _, report = localize.localize(df, found, True, window=100, stride=10, most_characters=20_000)
    assert {r.doc_id: (r.status, r.reason) for r in report.collect()}[1] == ("failed", "window_character_budget_exhausted")
    apart = spark.createDataFrame([(1, ("MARK" + " " * 300) * 5)], TEXTS)
    spans_, report = localize.localize(apart, found, False, window=100, stride=100, most_spans=3)
    assert report.first().reason == "span_limit_exceeded" and spans_.count() == 0
    with pytest.raises(ValueError):
        localize.localize(df, found, True, window=10, stride=20)


# Edits ---------------------------------------------------------------------------------------


def test_minimal_edits_near_signals(spark):
    text = "However we utilize it. Nobody cares. THEREFORE numerous NuMerous people purchase, typically."
    at = text.index("numerous")
    df = spark.createDataFrame([(1, text), (2, "utilize"), (3, "nothing here")], TEXTS)
    signal = spark.createDataFrame(
        [(1, at, at + 8, 9.0, 0.001, 4.0), (1, 11, 18, 5.0, 0.04, 4.0), (3, 0, 7, 1.0, 0.1, 1.0)],
        "doc_id long, start int, end int, score double, p_value double, threshold double",
    )
    ranked = strategies.ranked_edits(df, signal).orderBy("rank").collect()
    # On a signal first, the one of least chance before the other; then by distance.
    assert [r.original for r in ranked] == ["numerous", "utilize", "THEREFORE", "However"]
    out = strategies.candidates(df, signal, most_edits=2, limit=8).orderBy("candidate_index").collect()
    assert [r.n_edits for r in out] == [1, 2, 1, 1, 1, 2, 2, 2]
    assert out[0].candidate == text.replace("numerous", "many") and "THUS many" in {m for r in out for m in re.findall("THUS many", r.candidate)}
    assert len({r.candidate for r in out}) == 8 and {r.doc_id for r in out} == {1}
    with pytest.raises(ValueError):
        strategies.candidates(df, signal, limit=65)


def test_edit_characters(spark):
    pairs = [("abc", "abc"), ("abcd", "axcd"), ("", "xy"), ("a" * 3000 + "b", "a" * 2999 + "cd"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(strategies.edit_characters("a", "b")).collect()]
    assert got == [0, 1, 2, 2, None]


def test_mitigation_keeps_only_what_clears(spark):
    df = spark.createDataFrame(
        [(1, "People often meet here and they utilize tools every day of the long week."), (2, "Nothing to see here at all today."), (3, "We utilize this and numerous others as well on most days.")], TEXTS
    )

    def detector(rows, column):
        hit = F.col(column).rlike("utilize")
        return rows.withColumn("status", F.when(hit, "detected").otherwise("not_detected")).withColumn("margin", F.when(hit, 1.0).otherwise(-1.0))

    def strategy(rows):
        at = F.locate("utilize", F.col("text")) - 1
        signal = rows.where(at >= 0).select("doc_id", at.alias("start"), (at + 7).alias("end"), F.lit(5.0).alias("score"), F.lit(0.01).alias("p_value"), F.lit(4.0).alias("threshold"))
        return strategies.candidates(rows, signal)

    out = {r.doc_id: r for r in strategies.mitigate(df, detector, [strategy]).collect()}
    assert out[1].outcome == "cleared" and out[1].text == df.where("doc_id = 1").first().text.replace("utilize", "use")
    assert out[2].outcome == "not_detected" and out[3].outcome == "cleared" and "numerous" in out[3].text

    def strict(rows, column):
        return rows.withColumn("status", F.lit("detected")).withColumn("margin", F.lit(1.0))

    back = {r.doc_id: (r.outcome, r.text) for r in strategies.mitigate(df, detector, [strategy], verifier=strict).collect()}
    assert back[1] == ("rolled_back", df.where("doc_id = 1").first().text)


def test_span_snapping_against_python(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("ab  \n") for _ in range(60))) for i in range(30)]
    rows = [(i, *sorted((rng.randint(0, 60), rng.randint(0, 60)))) for i, _ in texts for _ in range(4)]
    words = spans.word_spans(spark.createDataFrame(texts, TEXTS))
    given = spark.createDataFrame(rows, "doc_id long, start int, end int")
    got = {(r.doc_id, r.start, r.end) for r in spans.snap(given, words).collect()}
    want, merged = set(), set()
    for i, t in texts:
        found = [m.span() for m in re.finditer(r"\S+", t)]
        runs = []
        for d, a, z in rows:
            hit = [k for k, (s, e) in enumerate(found) if d == i and a < z and s < z and e > a]
            if hit:
                want.add((i, found[hit[0]][0], found[hit[-1]][1]))
                runs.append((hit[0], hit[-1]))
        for lo, hi in sorted(runs):
            if merged and (m := [x for x in merged if x[0] == i and x[2] >= lo - 1 and x[1] <= lo]):
                merged.discard(m[0])
                merged.add((i, m[0][1], max(hi, m[0][2])))
            else:
                merged.add((i, lo, hi))
    places = {i: [m.span() for m in re.finditer(r"\S+", t)] for i, t in texts}
    assert got == want
    out = {(r.doc_id, r.start, r.end) for r in spans.merge(given, words).collect()}
    assert out == {(i, places[i][a][0], places[i][z][1]) for i, a, z in merged}


# Studies -------------------------------------------------------------------------------------


def test_order_statistics_by_ranges(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.choice([rng.randint(0, 20), rng.random() * 1000]))) for g in "ab" for _ in range(500)] + [("c", 1.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, score double")
    for q in (0.0, 0.05, 0.5, 0.95, 0.99, 1.0):
        got = {r.g: (r.n, r.score) for r in metrics.order_statistic(df, q, ["g"]).collect()}
        for g in "abc":
            v = sorted(s for h, s in rows if h == g)
            assert got[g] == (len(v), v[min(len(v) - 1, max(0, math.ceil(q * len(v)) - 1))])
        assert "d" not in got


def test_intervals_hold_the_truth(spark):
    """Means of clusters around 0.5: nine of ten 80 per cent intervals of many populations hold at least the truth's share."""
    rng = random.Random(7)
    rows = [(p, c, float(rng.random() < 0.5)) for p in range(40) for c in range(40) for _ in range(3)]
    df = spark.createDataFrame(rows, "p int, c int, value double")
    got = intervals.mean_interval(df, ["p"], "c", replicates=200, confidence=0.8).collect()
    assert 24 <= sum(r.ci_low <= 0.5 <= r.ci_high for r in got) <= 40
    scores = spark.createDataFrame([(i, i % 2 == 0, float(i % 10)) for i in range(200)], "c int, positive boolean, score double").withColumn("g", F.lit(1))
    whole = metrics.auroc(scores, ["g"]).first().auroc
    end = intervals.auroc_interval(scores, ["g"], "c").first()
    assert end.ci_low <= whole <= end.ci_high and end.ci_high - end.ci_low < 0.3
    both = scores.withColumn("before", F.col("score")).withColumn("after", F.col("score"))
    same = intervals.auroc_delta_interval(both, ["g"], "c").first()
    assert (same.ci_low, same.ci_high) == (0.0, 0.0)
    wide = evaluation.with_rate_intervals
    rows = [("positive", i % 20, float(i % 7)) for i in range(60)] + [(r, i % 20, float(i % 5)) for r in ("test_null", "calibration_null") for i in range(60)]
    df = spark.createDataFrame(rows, "role string, c int, before double").withColumn("after", F.col("before") / 2).withColumn("g", F.lit("g"))
    report = evaluation.fixed_fpr_report(df, 0.1, ["g"], "c")
    r = wide(df, report, ["g"], "c", replicates=50).first()
    assert r.tpr_before_cluster_low <= r.tpr_before <= r.tpr_before_cluster_high
    full = evaluation.mode_metrics(df.withColumn("similarity", F.lit(0.5)).withColumn("quality", F.lit(True)), ["g"], "c", 0.1, replicates=50).first()
    assert full.mean_similarity == 0.5 and full.quality_rate == 1.0 and full.auroc_before >= 0.5


def test_reports_say_what_is_missing(spark):
    rows = [("a", "positive", 1, 5.0)] + [("a", "calibration_null", i, 1.0) for i in range(30)] + [("a", "test_null", i % 2, 1.0) for i in range(30)]
    rows += [("b", "test_null", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, role string, c int, before double").withColumn("after", F.col("before"))
    got = {r.g: r for r in evaluation.fixed_fpr_report(df, 0.1, ["g"], "c").collect()}
    assert got["a"].reason_codes == ["held_out_test_null_clusters_not_estimable"] and got["a"].tpr_before is None and not got["a"].stable
    assert len(got["b"].reason_codes) == 4


def test_reviews(spark):
    schema = "assignment_id string, reviewer_id string, semantic int, factual int, fluency int, formatting int"
    good = [(f"a{i}", r, 1 + i % 5, 1 + i % 5, 3, 1 + (i + (r == "y")) % 5) for i in range(20) for r in ("x", "y")]
    names = spark.createDataFrame([(f"a{i}",) for i in range(20)], "assignment_id string")
    df = spark.createDataFrame(good, schema)
    assert evaluation.review_errors(df, names).count() == 0
    by, whole = evaluation.review_summary(df, replicates=40)
    alpha = {r.dimension: r.alpha for r in by.collect()}
    assert alpha["semantic"] == 1.0 and alpha["formatting"] < 0.9
    r = whole.first()
    assert (r.assignments, r.reviewers, r.responses) == (20, 2, 40) and r.ci_low <= r.agreement <= r.ci_high
    bad = spark.createDataFrame([*good[1:], ("zz", "x", 1, 1, 1, 1), ("a3", "x", 9, 1, 1, 1)], schema)
    assert {r.error for r in evaluation.review_errors(bad, names).collect()} == {
        "unknown assignment or reviewer", "rating outside 1 to 5", "rated more than once", "fewer than two ratings"
    }


def test_study_tables_and_checks(spark):
    samples = [(i, i, "calibration" if i < 60 else "final_test", "positive" if i >= 100 else "human_control" if i >= 95 else "null", "t", "en", "b", "k", i - 1 if i % 2 else None) for i in range(160)]
    s = spark.createDataFrame(samples, "sample_id long, cluster_id long, split string, cohort string, task string, language string, length_bin string, key_fingerprint string, paired_sample_id long")
    rows = [(i, d, "c", float(i), float(i) / 4, "accepted" if i % 5 else "failed", True, True, None if i % 5 else "timeout", None) for i in range(160) for d in ("d1", "d2")]
    obs = spark.createDataFrame(
        rows, "sample_id long, detector_id string, condition_id string, source_score double, candidate_score double, transformation_state string, quality_gate_passed boolean, "
        "task_check_passed boolean, error_class string, attempt_history array<struct<attempt_index:int,state:string,error_class:string>>"
    ).withColumn("telemetry", F.struct(F.lit(1.0).alias("wall_time_seconds"), F.lit(2).alias("peak_rss_bytes"), F.lit(None).cast("int").alias("remote_queries"), F.lit(3).alias("generated_tokens")))
    out = evaluation.aggregate_observations(obs, s, 0.05)
    paired = {r.detector_id: r for r in out["paired"].collect()}
    assert paired["d1"].threshold_before == 56.0 and paired["d1"].tpr_before == 1.0 and paired["d1"].estimable
    tried = {r.detector_id: r for r in out["attempts"].collect()}
    cleared = [i for i in range(100, 160) if i / 4 <= paired["d1"].threshold_after and i % 5]
    assert tried["d1"].attempted == 60 and tried["d1"].success_over_attempts == len(cleared) / 60
    assert out["confusion"].count() == 1 and out["controls"].first().n == 5 and out["failures"].first().n == 32
    assert out["telemetry"].first().remote_queries is None and out["strata"].count() == 2
    assert [r.sample_id for r in evaluation.ordered(obs.where("detector_id = 'd1'"), s, "final_test", "positive").collect()] == list(range(100, 160))
    wrong = evaluation.key_binding_errors(s.withColumn("key_fingerprint", F.when(F.col("sample_id") == 7, "z").otherwise("k")), spark.createDataFrame([("calibration", "k"), ("final_test", "k")], "split string, key_fingerprint string"))
    assert {(r.sample_id, r.error) for r in wrong.collect()} == {(7, "key of another split"), (7, "key differs from the paired sample")}
    reg = spark.createDataFrame([("g", "a", "1"), ("g", "b", "1")], "g string, detector_id string, key_sha256 string")
    r = evaluation.independence(reg, ["g"], ("detector_id", "key_sha256")).first()
    assert r.shared == ["key_sha256"] and not r.independent
    claims = spark.createDataFrame([("c", "r1", True, "reproduced"), ("c", "r2", False, "reproduced")], "claim_id string, record_id string, independent boolean, state string")
    c = evaluation.claim_eligibility(claims).first()
    assert c.qualifying == ["r1"] and not c.verified_claim_eligible
    controls = evaluation.human_controls(spark.createDataFrame([(1, "x")], "sample_id long, text string"), "final_test", "r")
    assert "text" not in controls.columns and evaluation.length_sweep()[0] == ("under_64", 32)
    moved = evaluation.transform_population(spark.createDataFrame([(1, "a b"), (2, "c"), (3, "")], TEXTS), lambda d: d.withColumn("candidate", F.when(F.col("text") != "", F.replace("text", F.lit(" "), F.lit("")))))
    assert {r.doc_id: r.state for r in moved.collect()} == {1: "accepted", 2: "abstained", 3: "failed"}
    assert evaluation.transformation_summary(moved.withColumn("g", F.lit(1)), ["g"]).first().failed_rate == 1 / 3


# Jobs, bundles, engine -----------------------------------------------------------------------


def test_scan_job(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("ok\nhe​llo\n", encoding="utf-8")
    (root / "sub" / "b.md").write_text("x y​", encoding="utf-8")
    (root / "c.txt").write_bytes(b"\xff\xfe bad")
    (root / "big.txt").write_text("z" * 5000)
    (root / "skip.bin").write_text("​")
    (tmp_path / ".inkstrata.toml").write_text('[scan]\nmax_file_bytes = 1000\nsuppressions = ["U+00A0"]\ndispositions = ["actionable", "contextual"]\n')
    policy = jobs.resolve_policy(start=str(root))
    assert policy.max_file_bytes == 1000 and jobs.resolve_policy(start=str(root), discover=False) == jobs.Policy()
    report = jobs.run(spark, str(root), policy, fix=True)
    found = {(r.path.rsplit("/", 1)[1], r.line, r.column, r.codepoint, r.state) for r in report.findings.collect()}
    assert found == {("a.txt", 2, 3, "U+200B", "new"), ("b.md", 1, 4, "U+200B", "new")}
    assert {r.path.rsplit("/", 1)[1]: r.error for r in report.errors.collect()} == {"c.txt": "not valid UTF-8", "big.txt": "over the size limit"}
    assert {r.path.rsplit("/", 1)[1]: r.cleaned for r in report.fixes.collect()} == {"a.txt": "ok\nhello\n", "b.md": "x y"}
    texts = spark.createDataFrame([("p", "ok\nhe​llo")], "path string, text string")
    fixes = sanitize.sanitize_with_edits(texts, normalize=False, key="path")
    assert [(r.line, r.column, r.original) for r in jobs.located_edits(texts, fixes).collect()] == [(2, 3, "​")]
    log = json.loads(jobs.sarif_logs(report.findings).where("path like '%a.txt'").first().log)
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["level"] == "error" and len(log["runs"][0]["tool"]["driver"]["rules"]) == 1
    again = jobs.screen(texts, baseline=scan.scan(texts), new_only=True)
    assert again.count() == 0
    jobs.write_fixes(report.fixes, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    for text in ("[scan]\nother = 1", "[scan]\nmax_file_bytes = true", "[scan]\ndispositions = ['x']", "[scan", "[scan]\nexclude = 'x'"):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(ValueError):
            jobs.load_policy(str(tmp_path / "bad.toml"))


def test_bundles(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string")
    make = lambda t, **k: bundles.create("exploratory", {"name": "n"}, {"rate": 0.5, "nan": float("nan")}, {"t": t}, {"core": "executed"}, {"steps": [{"name": "s", "artifact": "t"}]} | k)
    one = make(a)
    assert make(a.orderBy(F.desc("id")))["bundle_id"] == one["bundle_id"] != make(a.distinct())["bundle_id"]
    path = str(tmp_path / "b.json")
    bundles.write(path, one)
    assert bundles.read(path) == one and bundles.validate(one, {"t": a}, ("core",)) == []
    assert bundles.validate(one, {"t": a.limit(1)}) and bundles.validate(one | {"purpose": "x"}) and bundles.validate(one, areas=("other",))
    with pytest.raises(FileExistsError):
        bundles.write(path, one)
    with pytest.raises(ValueError):
        make(a, password="x")
    assert bundles.replay(one, {"s": lambda: a}, execute=True)[0]["state"] == "reproduced"
    assert bundles.replay(one, {"s": lambda: a.limit(1)}, execute=True)[0]["state"] == "differs"
    other = make(a, run=2)
    record = {"source_bundle_id": one["bundle_id"], "reproduced_bundle_id": other["bundle_id"], "independent": True}
    assert bundles.replication_problems(record, one, other) == [] and len(bundles.replication_problems(record | {"independent": False}, one, one)) == 3
    journal = bundles.Journal(spark, str(tmp_path / "journal"))
    plan = spark.createDataFrame([("u1",), ("u2",)], "unit string")
    assert journal.pending("r", plan).count() == 2
    journal.append("r", spark.createDataFrame([("u1", "done", "{}"), ("u2", "failed", "{}")], "unit string, state string, payload string"))
    assert [r.unit for r in journal.pending("r", plan).collect()] == ["u2"] and journal.pending("q", plan).count() == 2
    budget = bundles.Budget(records=3, tokens=10, seconds=60)
    assert budget.spend(2, 5) and not budget.spend(2) and budget.spend(1, 5) and not budget.spend(tokens=1) and budget.spent == {"records": 3, "tokens": 10}
    assert bundles.telemetry(1.0, 3.0, remote_queries=2) == {"wall_time_seconds": 2.0, "peak_rss_bytes": None, "remote_queries": 2, "generated_tokens": None, "estimated_cost_usd": None}
    assert "| 2 | y |" in bundles.results_markdown({"t": a}) and "left out" in bundles.results_markdown({"t": a}, 1)


def test_registries():
    names = {k: ["a", "b"] for k in ("splits", "tasks", "languages", "cohorts", "coverage_areas")}
    bins = [{"minimum_inclusive": 0, "maximum_exclusive": 64}, {"minimum_inclusive": 64, "maximum_exclusive": None}]
    assert bundles.protocol_problems(names | {"length_bins": bins}) == []
    assert len(bundles.protocol_problems(names | {"length_bins": bins[::-1], "tasks": ["a", "a"]})) == 2
    control = {"id": "none", "role": "negative_control", "adapter_required": False, "implementation_binding": "intrinsic_identity_transform"}
    good = {
        "frozen": True, "control_condition_id": "none", "analysis": {"method": "holm_bonferroni_cluster_paired_sign_test", "family": "detector_and_fixed_fpr", "alpha": 0.05},
        "conditions": [control, {"id": "mild", "role": "baseline", "adapter_required": True, "implementation_binding": "x"}],
    }
    assert bundles.comparator_problems(good) == []
    assert len(bundles.comparator_problems(good | {"frozen": False, "control_condition_id": "mild", "analysis": {}})) == 4


def test_engine(spark):
    texts = spark.createDataFrame([(1, "he​llo é"), (2, "plain")], TEXTS)
    options = engine.Options(extensions=("x",), allow_network=True)
    assert options.local_only() == engine.Options()
    plan = engine.create_plan("sanitize")
    out = {r.doc_id: r.cleaned for r in engine.apply_plan(texts, plan["digest"], "sanitize", consent=True).collect()}
    assert out == {1: "hello " + unicodedata.normalize("NFC", "é"), 2: "plain"}
    with pytest.raises(PermissionError):
        engine.apply_plan(texts, plan["digest"], "sanitize")
    with pytest.raises(ValueError):
        engine.apply_plan(texts, plan["digest"], "inspect", consent=True)
    with pytest.raises(ValueError):
        engine.apply_plan(texts, engine.create_plan("rewrite")["digest"], "rewrite", consent=True)
    e = engine.Engine()
    assert e.inspect(texts).where("doc_id = 1").first().invisible_char_count == 1
    assert {c["detector"] for c in e.capabilities()} >= {"reference-kgw"} and "secret" not in engine.public_capability("reference-kgw")
    with pytest.raises(PermissionError):
        engine.require_extension("reference-kgw", "detector", engine.Options())
    assert engine.require_extension("reference-kgw", "detector", engine.Options(extensions=("reference-kgw",)), consent=True)
    shapes = engine.schemas()
    assert e.sanitize(texts).schema.simpleString() == shapes["sanitized"].simpleString()
    assert e.detect(texts).count() == 6 and quality.evaluate is not None


# Gates and the whole way ---------------------------------------------------------------------


def test_gates(spark):
    import pandas as pd

    pairs = spark.createDataFrame(
        [(1, "one two three", "one two three"), (2, "has 5 items", "has items now"), (3, "a b c low", "a b c low"), (4, "a b c odd", "a b c odd")],
        "doc_id long, source string, candidate string",
    )
    seen = gates.Gate("first", lambda f: pd.DataFrame({"score": [0.1 if "low" in c else 7.0 if "odd" in c else 0.9 for c in f.candidate], "items": 3}), 0.5)
    second = gates.Gate("second", lambda f: pd.DataFrame({"score": 0.2, "items": [2] * len(f)}), 0.5, required=False)
    out = {r.doc_id: r for r in gates.evaluate_candidate(pairs, [seen, second]).collect()}
    assert {k: r.outcome for k, r in out.items()} == {1: "passed", 2: "rejected", 3: "rejected", 4: "abstained"}
    assert [d.decision for d in out[1].decisions] == ["passed", "failed"] and [d.decision for d in out[3].decisions] == ["failed", "skipped"]

    def broken(frame):
        raise RuntimeError("offline")

    out = {r.doc_id: r.outcome for r in gates.evaluate_candidate(pairs, [gates.Gate("x", broken, 0.5)]).collect()}
    assert out == {1: "abstained", 2: "rejected", 3: "abstained", 4: "abstained"}
    with pytest.raises(ValueError):
        gates.evaluate_candidate(pairs, [gates.Gate("Bad name", broken, 2.0)])
    assert gates.deterministic_pass(pairs).where("passed").count() == 3
    vectors = lambda texts: pd.DataFrame({"x": [float(len(t)) for t in texts], "y": 1.0})
    assert gates.similarity(pairs, "doc_id", vectors).where("abs(cosine - 1) < 1e-9").count() == 3
    assert gates.similarity(pairs, "doc_id").where("method = 'words'").count() == 4
    found = gates.outside_detector("x", lambda t: pd.DataFrame({"score": [None if "odd" in x else float(len(x)) for x in t], "p_value": 0.5}), 12.0)
    got = {r.doc_id: r.status for r in found(pairs, "source").collect()}
    assert got == {1: "detected", 2: "not_detected", 3: "not_detected", 4: "detector_error"}


def test_removal_and_profiles(spark):
    texts = spark.createDataFrame([(1, "he\u200bllo to all of the world"), (2, None), (3, "we meet at 5 today in town")], TEXTS)
    plain = {r.doc_id: r for r in removal.remove(texts).collect()}
    assert plain[1].text == "hello to all of the world" and plain[1].outcome == "sanitized" and plain[2].error == "no text" and plain[1].receipt.n_edits == 1
    found = localize.contains_detector("hello")
    rewrite = lambda d: d.withColumn("candidate", F.regexp_replace(F.replace("text", F.lit("hello"), F.lit("greetings")), "5 ", ""))
    out = {r.doc_id: r for r in removal.remove(texts, rewrite=rewrite, detector=found).collect()}
    assert out[1].outcome == "rewritten" and out[1].receipt.detector_before == "not_detected" and out[1].receipt.detector_after == "not_detected"
    assert out[3].outcome == "rewrite_rejected" and out[3].text == "we meet at 5 today in town" and out[2].outcome == "refused"
    profile = removal.build_profile("p", "d", ["v"], ["s"], {"rounds": 1, "beam": 2})
    assert removal.profile_problems(profile, ("d", "v", "s")) == []
    assert len(removal.profile_problems(profile | {"detector": "v"}, ("d", "v"))) == 3
    marked = spark.createDataFrame([(1, "People often meet here and they utilize tools every day of the long week.")], TEXTS)
    hit = localize.contains_detector("utilize")

    def edits(rows):
        at = F.locate("utilize", F.col("text")) - 1
        signal = rows.where(at >= 0).select("doc_id", at.alias("start"), (at + 7).alias("end"), F.lit(5.0).alias("score"), F.lit(0.01).alias("p_value"), F.lit(4.0).alias("threshold"))
        return strategies.candidates(rows, signal)

    parts = {"d": hit, "v": localize.contains_detector("utilize"), "s": edits}
    assert removal.mitigate_with_profile(marked, profile, parts, consent=True).first().outcome == "cleared"
    with pytest.raises(PermissionError):
        removal.mitigate_with_profile(marked, profile, parts)
    packet, key = evaluation.blinded_packet(spark.createDataFrame([(1, "a", "b")], "pair_id long, source string, candidate string"), "s")
    assert packet.columns == ["assignment_id", "a_sha256", "b_sha256"] and key.join(packet, "assignment_id").count() == 1
    cut = marked.select(spans.split(F.col("text"), 20).alias("c"), spans.split(F.col("text"), 20, lambda t, n: F.array(F.substring(t, 1, n))).alias("d")).first()
    assert "".join(cut.c) == marked.first().text and cut.d is None


def test_vectors_are_read_strictly(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"name":"n","scheme":"s","text":"t","expected_status":"detected","expected_score":1.0,"expected_effective_tokens":3}\n')
    assert session.load_vectors(spark, str(tmp_path / "v.json")).first().expected_score == 1.0
    (tmp_path / "w.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        session.load_vectors(spark, str(tmp_path / "w.json")).collect()
