"""Bootstrap intervals over clusters: rates, means, AUROC and paired differences.

Whole clusters are drawn again with Poisson weights from a hash of seed, replicate
and cluster, so a replicate needs no random state, is the same on every run, and
all of them are computed at once. The intervals follow the same estimators as a
resampling loop, not its random numbers. Tables that are multiplied by the number
of replicates hold one row a cluster (means) or a cluster and distinct score (AUROC).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES = 200
#: Chance of a weight of at most k, for k of 0 to 7.
STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def weight(seed: int, *parts: Column) -> Column:
    """A Poisson(1) number (8 at most) from the first 52 bits of SHA-256 of seed, replicate and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), *[p.cast("string") for p in parts])
    u = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return sum((F.when(u >= s, 1).otherwise(0) for s in STEPS), F.lit(0))


def drawn(rows: DataFrame, seed: int, replicates: int, *unit: Column) -> DataFrame:
    """``rows`` once for each replicate that draws their unit, with ``replicate`` and the weight ``w``."""
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return each.withColumn("w", weight(seed, *unit)).where("w > 0")


def percentiles(values: DataFrame, by: list[str], confidence: float) -> DataFrame:
    """The interval of ``value`` over replicates: ci_low and ci_high, order statistics."""
    alpha = (1 - confidence) / 2
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by value)")
    known = values.where("value is not null")
    if by:
        return known.groupBy(*by).agg(disc(alpha).alias("ci_low"), disc(1 - alpha).alias("ci_high"))
    return known.agg(disc(alpha).alias("ci_low"), disc(1 - alpha).alias("ci_high"))


def mean_interval(
    values: DataFrame, by: list[str], cluster: str, replicates: int = REPLICATES, seed: int = 0, confidence: float = 0.95
) -> DataFrame:
    """Interval of the mean of ``value`` (a rate, if 0 or 1) by group."""
    sums = values.groupBy(*by, cluster).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    mean = F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))
    means = drawn(sums, seed, replicates, F.col(cluster)).groupBy(*by, "replicate").agg(mean.alias("value"))
    return percentiles(means, by, confidence)


def paired_delta_interval(pairs: DataFrame, by: list[str], cluster: str, **options) -> DataFrame:
    """Interval of the mean of candidate minus source, pairs drawn together with their cluster."""
    delta = pairs.withColumn("value", F.col("candidate") - F.col("source"))
    return mean_interval(delta, by, cluster, **options)


def weighted_auroc(rows: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """AUROC by replicate of rows(by, replicate, positive, score, w)."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score))
    side = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0))
    counts = known.groupBy(*by, "replicate", score).agg(
        side(F.col("positive")).alias("p"), side(~F.col("positive")).alias("n")
    )
    order = Window.partitionBy(*by, "replicate").orderBy(score)
    below = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("won", F.col("p") * (below + 0.5 * F.col("n")))
    all_ = F.sum("p") * F.sum("n")
    return won.groupBy(*by, "replicate").agg(F.when(all_ > 0, F.sum("won") / all_).alias(name))


def units(cluster: str, joint: bool) -> list[Column]:
    """What is drawn: clusters with positives and nulls together, or each side's clusters for themselves."""
    return [F.col(cluster)] if joint else [F.col("positive").cast("int"), F.col(cluster)]


def auroc_interval(
    scores: DataFrame, by: list[str], cluster: str, joint: bool = False, replicates: int = REPLICATES, seed: int = 0, confidence: float = 0.95
) -> DataFrame:
    """Interval of the AUROC of scores(by, positive, cluster, score).

    A cluster column of its own value for each row draws rows, positives and
    nulls apart: the stratified bootstrap.
    """
    counted = scores.groupBy(*by, cluster, "positive", "score").agg(F.count("*").alias("m"))
    rows = drawn(counted, seed, replicates, *units(cluster, joint)).withColumn("w", F.col("w") * F.col("m"))
    return percentiles(weighted_auroc(rows, by, "score", "value"), by, confidence)


def auroc_delta_interval(
    pairs: DataFrame, by: list[str], cluster: str, joint: bool = True, replicates: int = REPLICATES, seed: int = 0, confidence: float = 0.95
) -> DataFrame:
    """Interval of the AUROC after minus before of pairs(by, positive, cluster, before, after), both from the same draws.

    ``joint`` draws a cluster's positives and nulls together, as is right where
    both sides have the same clusters.
    """
    counted = pairs.groupBy(*by, cluster, "positive", "before", "after").agg(F.count("*").alias("m"))
    rows = drawn(counted, seed, replicates, *units(cluster, joint)).withColumn("w", F.col("w") * F.col("m"))
    both = weighted_auroc(rows, by, "before", "b").join(weighted_auroc(rows, by, "after", "a"), [*by, "replicate"])
    return percentiles(both.withColumn("value", F.col("a") - F.col("b")), by, confidence)
