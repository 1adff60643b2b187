"""Localization of a signal: windows, family-wise control, merging of ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_count(length: Column, window: int, stride: int) -> Column:
    return F.when(length <= window, 1).otherwise(F.ceil((length - window) / stride).cast("int") + 1)


def windows(texts: DataFrame, window: int = 1200, stride: int = 600, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Overlapping character windows; the last one ends with the text. key, start, end, window_text."""
    n = F.length(column)
    starts = F.when(
        n > window,
        F.array_distinct(F.concat(F.sequence(F.lit(0), n - window, F.lit(stride)), F.array(n - window))),
    ).otherwise(F.array(F.lit(0)))
    placed = texts.where(F.col(column).isNotNull()).select(
        key,
        F.explode(
            F.transform(
                starts,
                lambda s: F.struct(
                    s.alias("start"),
                    F.least(n, s + window).alias("end"),
                    F.substring(F.col(column), s + 1, F.lit(window)).alias("window_text"),
                ),
            )
        ).alias("w"),
    )
    return placed.select(key, "w.*")


def merge_ranges(ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping or touching ranges become one: how many, the greatest margin, the least p-value."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).over(order)
    return (
        ranges.withColumn("island", island)
        .groupBy(key, "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("contributing_windows"),
            F.max("margin").alias("strongest_margin"),
            F.min("p_value").alias("smallest_p_value"),
        )
        .drop("island")
    )


def localize(
    texts: DataFrame,
    detector: Callable[[DataFrame, str], DataFrame],
    calibrated: bool,
    window: int = 1200,
    stride: int = 600,
    alpha: float = 0.05,
    key: str = "doc_id",
    most_characters: int = 4_000_000,
    most_spans: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """Spans and one report row a document.

    Documents whose windows hold more than ``most_characters`` in all, or that have
    more than ``most_spans`` spans, are refused: no spans, status failed, and the
    reason in the report.

    ``detector(df, column)`` adds status, margin and p_value. Only documents that
    are detected as a whole are cut into windows. With p-values and calibration
    the windows of a document share ``alpha`` (Bonferroni), else the result is
    exploratory; a window without a decision fails its document.
    """
    if window < 1 or not 1 <= stride <= window or not 0 < alpha < 1:
        raise ValueError("window, stride or alpha is out of bounds")
    whole = detector(texts.select(key, "text"), "text").select(key, "text", F.col("status").alias("full_status"))
    n = F.length("text")
    cost = window_count(n, window, stride).cast("long") * F.least(n, F.lit(window))
    whole = whole.withColumn("too_long", F.coalesce((F.col("full_status") == "detected") & (cost > most_characters), F.lit(False)))
    scored = detector(windows(whole.where("full_status = 'detected' and not too_long"), window, stride, key), "window_text")
    document = Window.partitionBy(key)
    scored = scored.withColumn("n_windows", F.count("*").over(document)).withColumn(
        "inconclusive", F.max((~F.col("status").isin("detected", "not_detected")).cast("int")).over(document)
    )
    controlled = F.lit(calibrated) & (F.count("p_value").over(document) == F.col("n_windows"))
    scored = scored.withColumn("controlled", controlled)
    positive = (F.col("status") == "detected") & (~F.col("controlled") | (F.col("p_value") <= alpha / F.col("n_windows")))
    spans = merge_ranges(scored.where((F.col("inconclusive") == 0) & positive).select(key, "start", "end", "margin", "p_value"), key)
    state = scored.groupBy(key).agg(
        F.max("n_windows").alias("windows_scored"), F.max("inconclusive").alias("inconclusive"), F.bool_and("controlled").alias("controlled")
    )
    counts = spans.groupBy(key).agg(F.count("*").alias("n_spans"))
    met = whole.select(key, "full_status", "too_long").join(state, key, "left").join(counts, key, "left")
    met = met.withColumn("too_many", F.coalesce(F.col("n_spans") > most_spans, F.lit(False)))
    spans = spans.join(counts.where(F.col("n_spans") > most_spans), key, "left_anti")
    reason = (
        F.when((F.col("full_status") != "detected") & (F.col("full_status") != "not_detected"), "full_document_inconclusive")
        .when(F.col("too_long"), "window_character_budget_exhausted")
        .when(F.col("inconclusive") == 1, "window_inconclusive")
        .when(F.col("too_many"), "span_limit_exceeded")
    )
    status = (
        F.when(F.col("full_status") == "not_detected", "not_detected")
        .when(F.coalesce(reason.isNotNull(), F.lit(False)), "failed")
        .when(F.col("n_spans").isNull(), "not_localized")
        .when(F.col("controlled"), "localized")
        .otherwise("localized_exploratory")
    )
    method = (
        F.when((F.col("full_status") != "detected") | F.col("too_long") | (F.col("inconclusive") == 1), "none")
        .when(F.col("controlled"), "bonferroni_windows")
        .otherwise("exploratory_windows")
    )
    report = met.select(
        key,
        status.alias("status"),
        method.alias("method"),
        F.coalesce("windows_scored", F.lit(0)).cast("long").alias("windows_scored"),
        F.when(F.col("too_many"), 0).otherwise(F.coalesce("n_spans", F.lit(0))).alias("n_spans"),
        reason.alias("reason"),
    )
    return spans, report


def contains_detector(mark: str, p_hit: float = 0.0001, p_miss: float = 0.9) -> Callable[[DataFrame, str], DataFrame]:
    """A detector that is positive where the text holds ``mark``; for tests and examples."""

    def run(df: DataFrame, column: str) -> DataFrame:
        hit = F.col(column).contains(mark)
        return (
            df.withColumn("status", F.when(hit, "detected").otherwise("not_detected"))
            .withColumn("margin", F.when(hit, 1.0).otherwise(-1.0))
            .withColumn("p_value", F.when(hit, p_hit).otherwise(p_miss))
        )

    return run
