"""Checks of sample registries and observation sets as relational queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length bins by effective tokens, as (name, first, end).
LENGTH_BINS = (("under_64", 0, 64), ("64_127", 64, 128), ("128_255", 128, 256), ("256_511", 256, 512), ("512_up", 512, None))


def length_bin(tokens: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in LENGTH_BINS:
        out = F.when((tokens >= lo) & (tokens < hi if hi else F.lit(True)), name).otherwise(out)
    return out


def leaking_clusters(samples: DataFrame, cluster: str = "cluster_id", split: str = "split") -> DataFrame:
    """Clusters (or keys) that occur in more than one split."""
    return samples.groupBy(cluster).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def missing_cells(samples: DataFrame, outer: DataFrame, inner: dict[str, list[str]]) -> DataFrame:
    """Cells of the required matrix without a sample.

    ``outer`` holds the wanted values of one dimension, however many; ``inner`` the
    registry's values of the others. Each outer value keeps the set of inner cells
    that it has, no larger than the registry's, and only missing cells become rows.
    """
    (name,) = outer.columns
    cells = [[]]
    for values in inner.values():
        cells = [[*c, v] for c in cells for v in values]
    cell = lambda values: F.struct(*[v.alias(n) for n, v in zip(inner, values, strict=True)])
    every = F.array(*[cell(map(F.lit, c)) for c in cells])
    have = samples.select(name, *inner).distinct().groupBy(name).agg(F.collect_list(cell(map(F.col, inner))).alias("have_"))
    met = outer.distinct().join(have, name, "left")
    left = F.when(F.col("have_").isNull(), every).otherwise(F.array_except(every, F.col("have_")))
    return met.select(name, F.explode(left).alias("cell_")).select(name, "cell_.*")


def missing_observations(samples: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    return samples.select(*keys).distinct().join(observations.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unmatched_nulls(samples: DataFrame, fields: list[str]) -> DataFrame:
    """Nulls whose paired positive is missing or differs in a field that must agree."""
    nulls = samples.where("paired_sample_id is not null")
    partner = samples.select(F.col("sample_id").alias("paired_sample_id"), *[F.col(f).alias(f"p_{f}") for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"p_{f}"))
    return nulls.join(partner, "paired_sample_id", "left").where(differs).select("sample_id", "paired_sample_id")


def strata(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of detections before and after by stratum."""
    b, a = F.col("before"), F.col("after")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(b).alias("detected"),
        F.count_if(b & ~a).alias("cleared"),
        F.count_if(b & a).alias("residual"),
    )


def merge_coverage(registry: DataFrame, execution: DataFrame) -> DataFrame:
    """Registry states, overlaid by what was executed: area, state."""
    done = execution.select("area", F.col("state").alias("executed"))
    return registry.join(done, "area", "left").select("area", F.coalesce("executed", "state").alias("state"))


def sample_seed(*parts: Column) -> Column:
    """A 63-bit seed from coordinates."""
    head = F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 15)
    return F.conv(head, 16, 10).cast("long")


def blinded_order(pairs: DataFrame, seed: str) -> DataFrame:
    """Which side is shown first, by a hash of the assignment."""
    coin = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("pair_id").cast("string")).cast("binary"), 256), 1, 1)
    return pairs.withColumn("first_is_source", coin < "8")


def score_table_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Content address of a score table, whatever the order of its rows.

    Row hashes are cut into four numbers and summed: equal multisets of rows, and
    for all practical purposes only those, give equal sums. The digest is the hash
    of the sums and the number of rows, so no group is ever collected.
    """
    each = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda i: F.conv(F.substring("row_", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*by, each.alias("row_")).groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(4)]
    )
    whole = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")])
    return sums.select(*by, "n", F.sha2(whole.cast("binary"), 256).alias("digest"))


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that no checkpoint row records yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")
