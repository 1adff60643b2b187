"""Reports on paired scores: fixed false-positive rates, attempts, composite success, reviews, observation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals, metrics, protocol

ROLES = ("positive", "test_null", "calibration_null")


def rate(test: Column, among: Column) -> Column:
    return F.when(F.count_if(among) > 0, F.count_if(among & test) / F.count_if(among))


def fixed_fpr_report(rows: DataFrame, fpr: float, by: list[str], cluster: str) -> DataFrame:
    """Rates before and after at thresholds set on nulls that are not tested; rows(by, role, cluster, before, after).

    Thresholds are those of the calibration nulls, for each side its own. A group
    is estimable when both thresholds are, when there are enough test nulls and
    clusters of them, and positives; ``reason_codes`` says what is missing, and
    rates are null then. ``stable`` asks for twenty times as many.
    """
    nulls = rows.where("role = 'calibration_null'")
    side = lambda c: metrics.calibration(nulls.withColumn("score", F.col(c)), fpr, by, cluster).select(
        *by, F.col("threshold").alias(f"threshold_{c}"), F.col("stable").alias(f"stable_{c}")
    )
    met = rows.where("role <> 'calibration_null'").join(side("before"), by, "left").join(side("after"), by, "left")
    positive, null = F.col("role") == "positive", F.col("role") == "test_null"
    before, after = F.col("before") > F.col("threshold_before"), F.col("after") > F.col("threshold_after")
    need, enough = metrics.minimum_nulls(fpr), metrics.recommended_nulls(fpr)
    out = met.groupBy(*by).agg(
        F.first("threshold_before").alias("threshold_before"),
        F.first("threshold_after").alias("threshold_after"),
        F.first("stable_before").alias("stable_before"),
        F.first("stable_after").alias("stable_after"),
        F.count_if(positive).alias("positive_samples"),
        F.count_if(null).alias("test_null_samples"),
        F.countDistinct(F.when(null, F.col(cluster))).alias("test_null_clusters"),
        rate(before, positive).alias("tpr_before"),
        rate(after, positive).alias("tpr_after"),
        rate(before, null).alias("test_fpr_before"),
        rate(after, null).alias("test_fpr_after"),
        F.count_if(positive & before).alias("detected"),
        F.count_if(positive & before & ~after).alias("cleared"),
        F.count_if(positive & before & after).alias("residual"),
        F.count_if(null & ~before & after).alias("false_inserted"),
    )
    rules = (
        (F.col("threshold_before").isNull() | F.col("threshold_after").isNull(), "calibration_null_not_estimable"),
        (F.col("test_null_samples") < need, "held_out_test_null_not_estimable"),
        (F.col("test_null_clusters") < need, "held_out_test_null_clusters_not_estimable"),
        (F.col("positive_samples") == 0, "positive_population_empty"),
    )
    reasons = F.filter(F.array(*[F.when(test, reason) for test, reason in rules]), lambda r: r.isNotNull())
    out = out.withColumn("reason_codes", reasons).withColumn("estimable", F.size("reason_codes") == 0)
    stable = F.col("estimable") & F.col("stable_before") & F.col("stable_after")
    stable &= (F.col("test_null_samples") >= enough) & (F.col("test_null_clusters") >= enough)
    out = out.withColumn("stable", F.coalesce(stable, F.lit(False))).drop("stable_before", "stable_after")
    known = ("tpr_before", "tpr_after", "test_fpr_before", "test_fpr_after", "detected", "cleared", "residual", "false_inserted")
    out = out.withColumns({c: F.when(F.col("estimable"), F.col(c)) for c in known})
    ends = {}
    for c, n in zip(known[:4], ("positive_samples", "positive_samples", "test_null_samples", "test_null_samples"), strict=True):
        low, high = metrics.wilson(F.col(c) * F.col(n), F.col(n))
        ends |= {f"{c}_ci_low": F.when(F.col("estimable"), low), f"{c}_ci_high": F.when(F.col("estimable"), high)}
    return out.withColumns(ends)


def with_rate_intervals(rows: DataFrame, report: DataFrame, by: list[str], cluster: str, **options) -> DataFrame:
    """``fixed_fpr_report`` with the cluster bootstrap interval of each rate."""
    limits = report.where("estimable").select(*by, "threshold_before", "threshold_after")
    met = rows.join(limits, by)
    for name, role, c, seed in (
        ("tpr_before", "positive", "before", 10), ("tpr_after", "positive", "after", 11),
        ("test_fpr_before", "test_null", "before", 12), ("test_fpr_after", "test_null", "after", 13),
    ):
        flags = met.where(F.col("role") == role).withColumn("value", (F.col(c) > F.col(f"threshold_{c}")).cast("double"))
        found = intervals.mean_interval(flags, by, cluster, seed=seed, **options)
        renamed = found.withColumnsRenamed({"ci_low": f"{name}_cluster_low", "ci_high": f"{name}_cluster_high"})
        report = report.join(renamed, by, "left")
    return report


ATTEMPT = "struct<attempt_index:int,state:string,error_class:string>"


def attempt_rows(observations: DataFrame) -> DataFrame:
    """One row an attempt: those of ``attempt_history``, or the observation's own state as the only one."""
    own = F.array(F.struct(F.lit(1).alias("attempt_index"), F.col("transformation_state").alias("state"), F.col("error_class").alias("error_class")))
    told = F.transform(
        "attempt_history",
        lambda a: F.struct(a["attempt_index"].cast("int").alias("attempt_index"), a["state"].alias("state"), a["error_class"].alias("error_class")),
    )
    listed = F.when(F.coalesce(F.size("attempt_history"), F.lit(0)) > 0, told).otherwise(own)
    keys = ["sample_id", "detector_id", "condition_id"]
    rows = observations.select(*keys, F.posexplode(listed).alias("i", "a"), F.size(listed).alias("n"))
    return rows.select(*keys, "a.*", (F.col("i") + 1 == F.col("n")).alias("is_final"))


def final_success(source_threshold: Column, candidate_threshold: Column, source_operator: str, candidate_operator: str, direction: str) -> Column:
    """Whether an observation succeeded: flagged before, not after, accepted, and past both checks."""
    sign = -1.0 if direction == "lower" else 1.0
    flag = lambda c, limit, operator: metrics.threshold_flag(sign * F.col(c), limit, operator)
    good = (F.col("transformation_state") == "accepted") & F.col("quality_gate_passed") & F.col("task_check_passed")
    won = flag("source_score", source_threshold, source_operator) & ~flag("candidate_score", candidate_threshold, candidate_operator) & good
    return F.coalesce(won, F.lit(False))


def attempt_successes(observations: DataFrame, **limits) -> DataFrame:
    """Every attempt with ``success``, which only the last one of an observation can have."""
    keys = ["sample_id", "detector_id", "condition_id"]
    won = observations.select(*keys, final_success(**limits).alias("won"))
    rows = attempt_rows(observations).join(won, keys)
    return rows.withColumn("success", F.col("is_final") & F.col("won")).drop("won")


def transformation_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """How many transformations were tried, accepted, failed and abstained, and the shares."""
    state = lambda s: F.count_if(F.col("state") == s)
    counts = rows.groupBy(*by).agg(F.count("*").alias("attempted"), *[state(s).alias(s) for s in ("accepted", "failed", "abstained")])
    return counts.withColumns({f"{s}_rate": F.col(s) / F.col("attempted") for s in ("accepted", "failed", "abstained")})


def composite_success(rows: DataFrame, by: list[str]) -> DataFrame:
    """Flagged before, cleared, accepted and past the quality gate; over all, and over those flagged at first.

    rows(by, source_flag, candidate_flag, state, quality); a null flag is no flag and clears nothing.
    """
    first = F.coalesce(F.col("source_flag"), F.lit(False))
    won = first & F.coalesce(~F.col("candidate_flag"), F.lit(False)) & (F.col("state") == "accepted") & F.coalesce("quality", F.lit(False))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("attempted"), F.count_if(first).alias("initially_detected"), F.count_if(won).alias("successes")
    )
    ends = {}
    for name, n in (("initially_detected", F.col("initially_detected")), ("attempted", F.col("attempted"))):
        low, high = metrics.wilson(F.col("successes"), n)
        ends |= {f"rate_over_{name}": F.when(n > 0, F.col("successes") / n), f"low_over_{name}": low, f"high_over_{name}": high}
    return out.withColumns(ends)


def score_table(rows: DataFrame, source_threshold: float, candidate_threshold: float) -> DataFrame:
    """Per sample: scores, flags, and what became of it; rows(sample_id, detector, cohort, source_score, candidate_score, state)."""
    before, after = F.col("source_score") > source_threshold, F.col("candidate_score") > candidate_threshold
    return rows.select(
        "sample_id", "detector", "cohort", "source_score", "candidate_score", "state",
        before.alias("source_flag"), after.alias("candidate_flag"), metrics.outcome_label(F.col("cohort"), before, after).alias("outcome"),
    )


def mode_metrics(rows: DataFrame, by: list[str], cluster: str, fpr: float, **options) -> DataFrame:
    """All measures of a transformation on one row a group: AUROC before and after with the interval of their difference,
    the report at a fixed rate, and mean similarity and quality of positives.

    rows(by, role, cluster, before, after, similarity, quality).
    """
    report = fixed_fpr_report(rows, fpr, by, cluster)
    tested = rows.where("role <> 'calibration_null'").withColumn("positive", F.col("role") == "positive")
    for c in ("before", "after"):
        found = metrics.auroc(tested.withColumn("score", F.col(c)), by).select(*by, F.col("auroc").alias(f"auroc_{c}"))
        report = report.join(found, by, "left")
    delta = intervals.auroc_delta_interval(tested, by, cluster, **options)
    report = report.join(delta.withColumnsRenamed({"ci_low": "auroc_delta_low", "ci_high": "auroc_delta_high"}), by, "left")
    means = tested.where("positive").groupBy(*by).agg(
        F.avg("similarity").alias("mean_similarity"), F.avg(F.col("quality").cast("double")).alias("quality_rate")
    )
    return report.join(means, by, "left")


DIMENSIONS = ("semantic", "factual", "fluency", "formatting")


def review_errors(reviews: DataFrame, assignments: DataFrame) -> DataFrame:
    """What is wrong with reviews(assignment_id, reviewer_id, four ratings): one row a fault."""
    known = reviews.join(assignments.select("assignment_id").distinct().withColumn("known_", F.lit(True)), "assignment_id", "left")
    named = lambda df, why: df.select("assignment_id", "reviewer_id", F.lit(why).alias("error"))
    outside = F.lit(False)
    for d in DIMENSIONS:
        outside = outside | F.coalesce(~F.col(d).between(1, 5), F.lit(True))
    twice = reviews.groupBy("assignment_id", "reviewer_id").count().where("count > 1")
    few = assignments.select("assignment_id").distinct().join(
        reviews.groupBy("assignment_id").agg(F.countDistinct("reviewer_id").alias("n")), "assignment_id", "left"
    )
    few = few.where(F.coalesce("n", F.lit(0)) < 2).withColumn("reviewer_id", F.lit(None).cast("string"))
    return (
        named(known.where("known_ is null or reviewer_id is null or reviewer_id = ''"), "unknown assignment or reviewer")
        .unionByName(named(known.where(outside), "rating outside 1 to 5"))
        .unionByName(named(twice, "rated more than once"))
        .unionByName(named(few, "fewer than two ratings"))
    )


def review_ratings(reviews: DataFrame) -> DataFrame:
    """Ratings as rows: dimension, unit (the assignment), rating."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("rating")) for d in DIMENSIONS])
    return reviews.select(F.col("assignment_id").alias("unit"), F.explode(pairs).alias("r")).select("unit", "r.*")


def review_summary(reviews: DataFrame, replicates: int = intervals.REPLICATES, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Agreement by dimension, and one row of totals: mean agreement with its interval over assignments, and counts.

    Assignments are drawn again with Poisson weights; an assignment drawn w times counts as w units.
    """
    ratings = review_ratings(reviews)
    by_dimension = metrics.interval_alpha(ratings)
    unit = ratings.groupBy("dimension", "unit").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q")
    )
    rows = intervals.drawn(unit, seed, replicates, F.col("unit"))
    total = lambda c: F.sum(F.col("w") * c)
    n, s, q = (F.col(c) for c in "nsq")
    sums = rows.groupBy("replicate", "dimension").agg(
        total(n * q - s * s).alias("within"), total(n * (n - 1) / 2).alias("pairs"), total(n).alias("n"), total(s).alias("s"), total(q).alias("q")
    )
    observed, expected = F.col("within") / F.col("pairs"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1) / 2)
    alpha = F.when(F.col("pairs") > 0, F.when(expected == 0, F.when(observed == 0, 1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - observed / expected))))
    means = sums.withColumn("alpha", alpha).groupBy("replicate").agg(F.avg("alpha").alias("value"))
    counts = reviews.agg(
        F.countDistinct("assignment_id").alias("assignments"), F.countDistinct("reviewer_id").alias("reviewers"), F.count("*").alias("responses")
    )
    whole = by_dimension.agg(F.avg("alpha").alias("agreement")).join(intervals.percentiles(means, [], 0.95)).join(counts)  # one row each
    return by_dimension, whole


def ordered(observations: DataFrame, samples: DataFrame, split: str, cohort: str) -> DataFrame:
    """Observations of one split and cohort, by sample."""
    wanted = samples.where((F.col("split") == split) & (F.col("cohort") == cohort)).select("sample_id")
    return observations.join(wanted, "sample_id", "left_semi").orderBy("sample_id")


IDENTITY = ("detector_id", "implementation_sha256", "configuration_sha256", "key_sha256", "model_sha256", "runtime_sha256")


def independence(registry: DataFrame, by: list[str], identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Whether no two detectors of a group share a part of their identity; ``shared`` names the parts that two share or one lacks."""
    counts = registry.groupBy(*by).agg(F.count("*").alias("detectors"), *[F.countDistinct(c).alias(c) for c in identity])
    shared = F.filter(F.array(*[F.when(F.col(c) < F.col("detectors"), c) for c in identity]), lambda c: c.isNotNull())
    return counts.select(*by, "detectors", shared.alias("shared")).withColumn("independent", F.size("shared") == 0)


def failure_classes(observations: DataFrame) -> DataFrame:
    """How often each error occurred, by detector, condition and state."""
    failed = attempt_rows(observations).where("error_class is not null")
    return failed.groupBy("detector_id", "condition_id", "state", "error_class").agg(F.count("*").alias("n"))


def aggregate_observations(
    observations: DataFrame, samples: DataFrame, fpr: float, calibration: str = "calibration", test: str = "final_test"
) -> dict[str, DataFrame]:
    """The tables of a study, by detector and condition: paired, attempts, strata, controls, confusion, failures, telemetry.

    observations as in the registry's schema, samples(sample_id, cluster_id, split,
    task, language, cohort, length_bin, key_fingerprint); cohorts are positive,
    null and human_control. Thresholds come from nulls of the calibration split.
    """
    by = ["detector_id", "condition_id"]
    facts = samples.select("sample_id", "cluster_id", "split", "cohort", "task", "language", "length_bin", "key_fingerprint")
    rows = observations.join(facts, "sample_id")
    rows = rows.withColumns({"before": F.col("source_score"), "after": F.col("candidate_score")})
    tested, null = F.col("split") == test, F.col("cohort") == "null"
    role = F.when((F.col("split") == calibration) & null, "calibration_null").when(tested & null, "test_null")
    role = role.when(tested & (F.col("cohort") == "positive"), "positive")
    paired = fixed_fpr_report(rows.withColumn("role", role).where("role is not null"), fpr, by, "cluster_id")
    limits = paired.select(*by, "threshold_before", "threshold_after")
    final = rows.where(tested).join(limits, by, "left")
    positives = final.where("cohort = 'positive'")
    flags = positives.withColumns(
        {"before": F.col("before") > F.col("threshold_before"), "after": F.col("after") > F.col("threshold_after")}
    )
    won = final_success(F.col("threshold_before"), F.col("threshold_after"), ">", ">", "higher")
    tried = attempt_rows(positives).join(positives.select("sample_id", *by, won.alias("won")), ["sample_id", *by])
    tried = tried.withColumn("success", F.col("is_final") & F.col("won"))
    human = final.where("cohort = 'human_control'")
    pairs = final.select("sample_id", "condition_id", "detector_id", (F.col("after") > F.col("threshold_after")).alias("flag"))
    other = pairs.withColumnsRenamed({"detector_id": "second_id", "flag": "second"})
    crossed = pairs.withColumnsRenamed({"detector_id": "first_id", "flag": "first"}).join(other, ["sample_id", "condition_id"])
    telemetry = observations.select(*by, "telemetry.*")
    return {
        "paired": paired,
        "attempts": metrics.attempts(tried, by),
        "strata": protocol.strata(flags, [*by, "task", "language", "length_bin", "key_fingerprint"]),
        "controls": human.groupBy(*by).agg(
            F.count("*").alias("n"), rate(F.col("before") > F.col("threshold_before"), F.lit(True)).alias("fpr_before"),
            rate(F.col("after") > F.col("threshold_after"), F.lit(True)).alias("fpr_after"),
        ),
        "confusion": metrics.confusion(crossed.where("first_id < second_id"), ["condition_id", "first_id", "second_id"]),
        "failures": failure_classes(observations),
        "telemetry": metrics.combine_telemetry(telemetry, by),
    }


def detect_population(texts: DataFrame, detector, column: str = "text") -> DataFrame:
    """Score and status of each text of a cohort, by a detector that is a function of (texts, column)."""
    return detector(texts, column)


def transform_population(texts: DataFrame, transform, check: Column | None = None) -> DataFrame:
    """Texts with ``candidate`` and ``state``: accepted, abstained (unchanged) or failed (no text, or the check fails)."""
    out = transform(texts)
    fine = F.coalesce(check, F.lit(False)) if check is not None else F.lit(True)
    state = F.when(F.col("candidate").isNull() | ~fine, "failed").when(F.col("candidate") == F.col("text"), "abstained").otherwise("accepted")
    return out.withColumn("state", state)


def key_binding_errors(samples: DataFrame, split_keys: DataFrame) -> DataFrame:
    """Samples whose key is not their split's, or not that of the positive that they are paired with: sample_id, error."""
    wanted = split_keys.select("split", F.col("key_fingerprint").alias("wanted_"))
    wrong = samples.join(wanted, "split", "left").where(~F.col("key_fingerprint").eqNullSafe(F.col("wanted_")))
    partner = samples.select(F.col("sample_id").alias("paired_sample_id"), F.col("key_fingerprint").alias("partner_"))
    apart = samples.where("paired_sample_id is not null").join(partner, "paired_sample_id", "left")
    apart = apart.where(~F.col("key_fingerprint").eqNullSafe(F.col("partner_")))
    named = lambda df, why: df.select("sample_id", F.lit(why).alias("error"))
    return named(wrong, "key of another split").unionByName(named(apart, "key differs from the paired sample"))


def human_controls(controls: DataFrame, split: str, rule_sha256: str) -> DataFrame:
    """Control records that name a text by its hash only: sample_id, split, cohort, input_sha256, n_chars, selection_rule_sha256."""
    return controls.select(
        "sample_id", F.lit(split).alias("split"), F.lit("human_control").alias("cohort"),
        F.sha2(F.col("text").cast("binary"), 256).alias("input_sha256"), F.length("text").alias("n_chars"),
        F.lit(rule_sha256).alias("selection_rule_sha256"),
    )


def length_sweep() -> list[tuple[str, int]]:
    """A token count in the middle of each length bin; the open one counts as wide as it begins."""
    return [(name, (first + (end or 2 * first)) // 2) for name, first, end in protocol.LENGTH_BINS]


def covered_bins(samples: DataFrame, by: list[str]) -> DataFrame:
    """Observed and missing length bins of each group of samples(by, length_bin)."""
    every = F.array(*[F.lit(name) for name, *_ in protocol.LENGTH_BINS])
    seen = samples.groupBy(*by).agg(F.sort_array(F.collect_set("length_bin")).alias("observed"))
    return seen.withColumn("missing", F.array_except(every, "observed"))


def claim_eligibility(records: DataFrame) -> DataFrame:
    """Replication records that qualify, by claim. They are listed only: no flag is ever raised by counting them."""
    fit = F.col("independent") & (F.col("state") == "reproduced")
    listed = F.sort_array(F.collect_list(F.when(fit, F.col("record_id"))))
    return records.groupBy("claim_id").agg(listed.alias("qualifying")).withColumns(
        {c: F.lit(False) for c in ("verified_claim_eligible", "public_claim_eligible")}
    )


def blinded_packet(pairs: DataFrame, seed: str, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """What reviewers see, and the key that they do not: pairs(pair_id, source, candidate).

    The packet has an assignment id that tells nothing, and both sides in an order
    by hash, as digests, or as texts if that is allowed. The key joins it back.
    """
    placed = protocol.blinded_order(pairs, seed)
    name = F.substring(F.sha2(F.concat_ws("\x1f", F.lit("assignment"), F.lit(seed), F.col("pair_id").cast("string")).cast("binary"), 256), 1, 24)
    side = lambda first: F.when(F.col("first_is_source") == first, F.col("source")).otherwise(F.col("candidate"))
    rows = placed.select(name.alias("assignment_id"), "pair_id", "first_is_source", side(True).alias("a"), side(False).alias("b"))
    shown = {f"{c}_sha256": F.sha2(F.col(c).cast("binary"), 256) for c in "ab"}
    packet = rows.withColumns(shown).select("assignment_id", *shown, *(["a", "b"] if with_text else []))
    return packet, rows.select("assignment_id", "pair_id", "first_is_source")
