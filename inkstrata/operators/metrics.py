"""Fixed-false-positive statistics over score tables: AUROC, thresholds, rates, comparisons."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def minimum_nulls(fpr: float) -> int:
    return math.ceil(1 / fpr)


def recommended_nulls(fpr: float, expected: int = 20) -> int:
    return expected * minimum_nulls(fpr)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; null for no trials."""
    p, n = successes / total, total
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n)
    some = total > 0
    return F.when(some, F.greatest(F.lit(0.0), middle - half)), F.when(some, F.least(F.lit(1.0), middle + half))


def ranged(scores: DataFrame, ranges: int) -> Column:
    """The range of a score among ``ranges`` of about equal size; bounds are read once, so every use agrees."""
    shares = [i / ranges for i in range(1, ranges)]
    bounds = scores.agg(F.percentile_approx("score", shares, 1000)).first()[0] or []
    distinct = sorted(set(bounds))
    if not distinct:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, distinct)), lambda b: b < F.col("score")))


def auroc(scores: DataFrame, by: list[str], ranges: int = 64) -> DataFrame:
    """Mann-Whitney AUROC with half credit for ties, by group; scores(by, positive boolean, score).

    Equal scores are counted first. Nulls below a score are those of lower ranges,
    from a table of one row a group and range, and those before it in its own
    range, so a group is worked on by as many tasks as there are ranges.
    """
    finite = scores.where("score is not null and not isnan(score)")
    counts = finite.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    counts = counts.withColumn("range", ranged(finite, ranges))
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("range"))
    lower = counts.groupBy(*by, "range").agg(F.sum("n").alias("m")).select(*by, "range", (upto - F.col("m")).alias("lower"))
    inside = Window.partitionBy(*by, "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("lower") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    won = counts.join(lower, [*by, "range"]).withColumn("won", F.col("p") * (below + 0.5 * F.col("n")))
    return won.groupBy(*by).agg(
        F.sum("p").alias("n_positive"),
        F.sum("n").alias("n_null"),
        F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum("won") / (F.sum("p") * F.sum("n"))).alias("auroc"),
    )


def order_statistic(scores: DataFrame, share: float, by: list[str], ranges: int = 64) -> DataFrame:
    """The score at rank ceil(share n) of each group, and n: by, n, score.

    The range that holds the rank is found from counts; only its scores are sorted.
    """
    finite = scores.where("score is not null and not isnan(score)").select(*by, "score")
    counts = finite.groupBy(*by, "score").agg(F.count("*").alias("n")).withColumn("range", ranged(finite, ranges))
    group = Window.partitionBy(*by)
    sizes = counts.groupBy(*by, "range").agg(F.sum("n").alias("m"))
    sizes = sizes.withColumn("upto", F.sum("m").over(group.orderBy("range"))).withColumn("total", F.sum("m").over(group))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total")))
    held = sizes.withColumn("rank", rank).where("upto - m < rank and rank <= upto")
    met = counts.join(held.select(*by, "range", "total", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank")), [*by, "range"])
    met = met.withColumn("seen", F.sum("n").over(group.orderBy("score"))).where("seen >= rank")
    return met.groupBy(*by).agg(F.max("total").alias("n"), F.min("score").alias("score"))


def thresholds(nulls: DataFrame, fpr: float, by: list[str]) -> DataFrame:
    """The null order statistic at 1 - fpr, null below the least number of nulls; flags are strictly above it."""
    found = order_statistic(nulls, 1 - fpr, by)
    enough = F.col("n") >= minimum_nulls(fpr)
    return found.select(*by, F.col("n").alias("null_samples"), F.when(enough, F.col("score")).alias("threshold"))


def tpr_at_fpr(scores: DataFrame, fpr: float, by: list[str]) -> DataFrame:
    """True and false positive rates at the threshold of each group's own nulls."""
    limit = thresholds(scores.where(~F.col("positive")), fpr, by)
    met = scores.join(limit, by)
    over = F.col("score") > F.col("threshold")
    known = F.col("threshold").isNotNull()
    return met.groupBy(*by).agg(
        F.first("threshold").alias("threshold"),
        F.avg(F.when(F.col("positive") & known, over.cast("double"))).alias("tpr"),
        F.avg(F.when(~F.col("positive") & known, over.cast("double"))).alias("fpr"),
    )


def calibration(nulls: DataFrame, fpr: float, by: list[str], cluster: str | None = None) -> DataFrame:
    """Threshold with its sample sizes, empirical rate and Wilson interval."""
    limit = thresholds(nulls, fpr, by)
    clusters = F.countDistinct(cluster) if cluster else F.count("*")
    met = nulls.join(limit.select(*by, "threshold"), by).groupBy(*by).agg(
        F.count("*").alias("null_samples"),
        clusters.alias("null_clusters"),
        F.first("threshold").alias("threshold"),
        F.count_if(F.col("score") > F.col("threshold")).alias("false_positives"),
    )
    usable = F.col("threshold").isNotNull() & (F.col("null_clusters") >= minimum_nulls(fpr))
    stable = (F.col("null_samples") >= recommended_nulls(fpr)) & (F.col("null_clusters") >= recommended_nulls(fpr))
    low, high = wilson(F.col("false_positives"), F.col("null_samples"))
    return met.select(
        *by,
        "null_samples",
        "null_clusters",
        usable.alias("estimable"),
        (usable & stable).alias("stable"),
        F.when(usable, F.col("threshold")).alias("threshold"),
        F.when(usable, F.col("false_positives") / F.col("null_samples")).alias("empirical_fpr"),
        F.when(usable, low).alias("ci_low"),
        F.when(usable, high).alias("ci_high"),
    )


def paired_outcomes(pairs: DataFrame, source_threshold: float, candidate_threshold: float, by: list[str]) -> DataFrame:
    """Cleared, residual and falsely inserted detections of pairs(positive, before, after)."""
    b, a = F.col("before") > source_threshold, F.col("after") > candidate_threshold
    p = F.col("positive")
    return pairs.groupBy(*by).agg(
        F.count_if(p & b).alias("detected"),
        F.count_if(p & b & ~a).alias("cleared"),
        F.count_if(p & b & a).alias("residual"),
        F.count_if(~p & ~b & a).alias("false_inserted"),
    )


def threshold_flag(score: Column, threshold: Column, operator: str) -> Column:
    return {">": score > threshold, ">=": score >= threshold, "<": score < threshold, "<=": score <= threshold}[operator]


def outcome_label(cohort: Column, before: Column, after: Column) -> Column:
    """What became of a sample: cohort and both flags in words."""
    flag = lambda c: F.when(c.isNull(), "unknown").when(c, "flagged").otherwise("clear")
    return F.concat_ws("_", cohort, flag(before), flag(after))


def select_strength(scores: DataFrame, nulls: DataFrame, fpr: float, target: float) -> DataFrame:
    """The least strength whose share of scores above the null threshold reaches ``target``."""
    limit = thresholds(nulls.withColumn("all_", F.lit(1)), fpr, ["all_"])
    # One row, and none without nulls.
    rates = scores.withColumn("all_", F.lit(1)).join(F.broadcast(limit), "all_").groupBy("strength").agg(
        F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("tpr")
    )
    return rates.where(F.col("tpr") >= target).agg(F.min("strength").alias("strength"))


def holm(tests: DataFrame, family: list[str], order: str) -> DataFrame:
    """Step-down adjusted p-values of tests(family, p_value), ties by ``order``."""
    w = Window.partitionBy(*family).orderBy("p_value", order)
    size = F.count("*").over(Window.partitionBy(*family))
    stepped = F.least(F.lit(1.0), (size - F.row_number().over(w) + 1) * F.col("p_value"))
    out = tests.withColumn("stepped", stepped)
    return out.withColumn("adjusted", F.max("stepped").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("stepped")


@F.pandas_udf(T.DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact two-sided sign test: the smaller binomial tail, doubled."""

    def one(a: int, b: int) -> float:
        n, k = int(a + b), int(min(a, b))
        if n == 0 or k == n // 2:
            return 1.0
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
        terms = [term]
        for i in range(k, 0, -1):
            term *= i / (n - i + 1)
            terms.append(term)
        return min(1.0, 2 * math.fsum(terms))

    return pd.Series([one(a, b) for a, b in zip(wins, losses, strict=True)], dtype="float64")


def paired_comparison(observations: DataFrame, control: str) -> DataFrame:
    """Cluster-level wins of each condition over the control, with sign test and Holm adjustment.

    observations(detector, condition, sample_id, cluster_id, success double).
    """
    base = observations.where(F.col("condition") == control).select(
        "detector", "sample_id", F.col("success").alias("control_success")
    )
    pairs = observations.where(F.col("condition") != control).join(base, ["detector", "sample_id"])
    clusters = pairs.groupBy("detector", "condition", "cluster_id").agg(
        F.avg("success").alias("s"), F.avg("control_success").alias("c")
    )
    wins = clusters.groupBy("detector", "condition").agg(
        F.count_if(F.col("s") > F.col("c")).alias("wins"), F.count_if(F.col("s") < F.col("c")).alias("losses")
    )
    return holm(wins.withColumn("p_value", sign_test("wins", "losses")), ["detector"], "condition")


def attempts(observations: DataFrame, by: list[str]) -> DataFrame:
    """Success over all attempts and over accepted ones; states accepted, failed, abstained."""
    state = lambda s: F.count_if(F.col("state") == s)
    good = F.count_if(F.col("success") & (F.col("state") == "accepted"))
    return observations.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        state("accepted").alias("accepted"),
        state("failed").alias("failed"),
        state("abstained").alias("abstained"),
        (good / F.count("*")).alias("success_over_attempts"),
        F.when(state("accepted") > 0, good / state("accepted")).alias("success_over_accepted"),
    )


def confusion(flags: DataFrame, by: list[str]) -> DataFrame:
    """Two detectors' flags crossed; rows with a null flag are left out."""
    a, b = F.col("first"), F.col("second")
    return flags.where("first is not null and second is not null").groupBy(*by).agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"),
        F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"),
    )


def combine_telemetry(rows: DataFrame, by: list[str]) -> DataFrame:
    """Wall time adds up, memory takes the peak, counters are null when any part is."""
    known = lambda c: F.when(F.count("*") == F.count(c), F.sum(c))
    return rows.groupBy(*by).agg(
        F.sum("wall_time_seconds").alias("wall_time_seconds"),
        F.max("peak_rss_bytes").alias("peak_rss_bytes"),
        known("remote_queries").alias("remote_queries"),
        known("generated_tokens").alias("generated_tokens"),
    )


def interval_alpha(ratings: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Krippendorff's interval alpha of ratings(dimension, unit, rating), from sums and squares alone."""
    unit = ratings.groupBy(dimension, "unit").agg(
        F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q")
    )
    gaps = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    total = unit.groupBy(dimension).agg(
        F.sum(gaps).alias("within"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    )
    observed = F.col("within") / F.col("pairs")
    expected = (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1) / 2)
    alpha = F.when(F.col("pairs") == 0, None).when(expected == 0, F.when(observed == 0, 1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - observed / expected))
    )
    return total.select(dimension, alpha.alias("alpha"))
