"""Mixing sources to target word counts by subset-sum budget fitting.

Every document's size is its number of words. Sources, in code-point order with
null last, have the weights 1, 2, 3 repeating and share the corpus' words by
weight; a target stops at ``max_repeats`` times its source's size and the excess
is shared anew by weight until none is above. A source takes all of its
documents ``floor(target / size)`` times; the rest of its budget is fitted once
more from the histogram of its document sizes: the same share of every size,
then one more of each size from the longest down while it fits, then a bounded
knapsack over the sizes that are left, by dynamic programming on the remaining
budget, which is then at most TABLE_WORDS or less than the longest document. How many documents of a
size go in is known from there; which ones is decided by a seeded hash.

Scale: one pass over the texts keeps (doc_id, source, size). A source's
histogram has at most one row for each distinct size: sqrt(2 x its words) rows at
the very most. Which documents of a hot size go in is found by hash range, so a
size that a third of all rows share is never sorted in one task.

Defined results: a null text has size 0; a null source is a source; sources
without words have target 0. Repeated rows, and rows that repeat an id (null
included), count as documents of their own; rows equal in all columns share what is
taken of them as evenly as can be. Ties in size go by a seeded hash of the row. Texts
of any length are counted whole. Extra columns pass through ``sample``, whatever their
names, but one named ``copies``, which gives way to the result. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Documents of one source and size per hash range, about.
RANGE_ROWS = 2000
#: Parts that documents of one source and size are dealt into when they meet their plan.
SALTS = 16
#: Remaining budget that is left to dynamic programming (or less than one document, if that is more).
TABLE_WORDS = 1 << 15


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def fit_targets(sizes: DataFrame, max_repeats: int) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: adds ``rank``, ``weight`` and ``target``.

    Sources are ranked by a range sort and offsets of its partitions, and the
    water level is found by aggregates, so neither needs all sources in one task.
    """
    ordered = store.shelve(
        sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), F.col("source"))
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
        "sources",
    )
    parts = sorted(ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect())
    before, offset = {}, 0
    for r in parts:
        before[r["part"]] = offset - r["first"]
        offset += r["n"]
    if not before:
        return ordered.select("source", "source_size", F.lit(1).alias("weight"), F.lit(0.0).alias("target"))
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.col("at") + offsets[F.col("part")]) % len(WEIGHTS)).cast("int"))
    weighed = ordered.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * max_repeats
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # Words by unit of weight, raised until the set of capped sources stays as it is.
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        r = weighed.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(over).alias("capped"),
        ).first()
        if r["capped"] == capped or not r["free"]:
            break
        level, capped = (total - r["fixed"]) / r["free"], r["capped"]
    return weighed.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def knapsack(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most ``spare``) make the sum nearest to ``budget``, the lower of two as near.

    Reachable sums are flags by sum, up to twice the budget; an entry remembers
    the first step that reached it, and the sum before that step was reached by
    an earlier one.
    """
    taken = np.zeros(len(sizes), np.int64)
    most = 2 * budget
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    step_of = np.full(most + 1, -1, np.int32)
    steps: list[tuple[int, int]] = []
    for i in np.argsort(sizes, kind="stable"):
        size, left, bundle = int(sizes[i]), int(min(spare[i], most // sizes[i])), 1
        while left > 0 and not reached[budget]:
            n = min(bundle, left)
            shift = n * size
            new = np.zeros_like(reached)
            new[shift:] = reached[:-shift]
            new &= ~reached
            step_of[new] = len(steps)
            reached |= new
            steps.append((int(i), n))
            left, bundle = left - n, bundle * 2
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, n = steps[step_of[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come near ``budget``."""
    total = int((sizes * counts).sum())
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((sizes * taken).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= TABLE_WORDS:
            break
        if taken[i] < counts[i] and sizes[i] <= rest:
            taken[i] += 1
            rest -= int(sizes[i])
    open_ = np.flatnonzero((taken < counts) & (sizes <= 2 * rest))
    if rest and len(open_):
        taken[open_] += knapsack(sizes[open_], counts[open_] - taken[open_], rest)
    return taken


def plan(histogram: DataFrame) -> DataFrame:
    """Adds ``repeats`` and ``extra``, the documents to take once more, to each row (source, size, n, source_size, target)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        total = int(rows.source_size.iloc[0])
        repeats = int(rows.target.iloc[0] // total)
        budget = int(round(rows.target.iloc[0] - repeats * total))
        extra = fit_budget(rows["size"].to_numpy(), rows.n.to_numpy(), min(budget, total))
        return rows[["source", "size", "n", "source_size", "target"]].assign(repeats=repeats, extra=extra)

    return (
        histogram.where("size > 0")
        .groupBy("source")
        .applyInPandas(one, "source string, size long, n long, source_size long, target double, repeats long, extra long")
    )


def choose(sized: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """``sized`` with ``repeats`` and ``once``, how many of its ``rows`` equal documents go in once more.

    Of a size, the ``extra`` documents with the least hash go in. They are dealt
    into hash ranges of about RANGE_ROWS; ranges below the cut go in whole, and
    only the range at the cut is ranked.
    """
    key = F.xxhash64(F.lit(seed), F.col("row_key"))
    ranges = F.greatest(F.lit(1), F.floor(F.col("n") / RANGE_ROWS)).cast("long")
    # Both tables grow with the corpus, so they are merged; a size that many documents share is dealt by salt.
    salted = sized.where("size > 0").withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    copies = planned.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    same = salted.source.eqNullSafe(copies.source_) & (salted["size"] == copies.size_) & (salted.salt == copies.salt_)
    dealt = store.shelve(
        salted.join(copies, same).select(
            *sized.columns,
            "repeats",
            "extra",
            "source_size",
            "target",
            key.alias("key"),
            F.pmod(F.shiftrightunsigned(key, 20), ranges).alias("range"),
        ),
        "dealt",
    )
    group = ["source", "size"]
    partial = dealt.where("extra > 0").groupBy(*group, "range").agg(F.sum("rows").alias("n"), F.max("extra").alias("extra"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("range"))
    cuts = store.shelve(
        partial.withColumn("upto", upto)
        .where("upto - n < extra")
        .select(
            F.col("source").alias("source_"),
            F.col("size").alias("size_"),
            F.col("range").alias("range_"),
            F.when(F.col("upto") <= F.col("extra"), None).otherwise(F.col("extra") - F.col("upto") + F.col("n")).alias("within"),
        ),
        "cuts",
    )
    met = dealt.join(
        cuts.hint("merge"),
        dealt.source.eqNullSafe(cuts.source_) & (dealt["size"] == cuts.size_) & (dealt.range == cuts.range_),
        "left",
    )
    before = F.sum("rows").over(Window.partitionBy(*group, "range").orderBy("key", "doc_id", "row_key")) - F.col("rows")
    some = F.greatest(F.lit(0).cast("long"), F.least(F.col("rows"), F.col("within") - before))
    split = met.where("within is not null").withColumn("once", some)
    whole = F.when(F.col("range_").isNotNull(), F.col("rows")).otherwise(0)
    rest = met.where("within is null").withColumn("once", whole)
    columns = [*sized.columns, "repeats", "once", "source_size", "target"]
    return split.select(*columns).unionByName(rest.select(*columns))


def row_key(documents: DataFrame):
    """A hash of all columns of a row; maps, which have no order, by their JSON."""
    text = lambda f: F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*[text(f) for f in documents.schema.fields])


def drawn(documents: DataFrame, max_repeats: int, seed: int) -> DataFrame:
    """The plan of the mix: doc_id, row_key, source, size, rows (equal ones), repeats, once, source_size and target."""
    sized = documents.select(
        "doc_id", row_key(documents).alias("row_key"), F.col("source").cast("string").alias("source"), word_count().alias("size")
    )
    sized = store.shelve(sized.groupBy(*sized.columns).agg(F.count("*").alias("rows")), "sized")
    histogram = store.shelve(sized.groupBy("source", "size").agg(F.sum("rows").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = store.shelve(fit_targets(sizes, max_repeats), "targets")
    aimed = targets.select(F.col("source").alias("source_"), "source_size", "target")
    planned = store.shelve(
        plan(histogram.join(aimed.hint("merge"), histogram.source.eqNullSafe(aimed.source_)).drop("source_")), "planned"
    )
    chosen = choose(sized, planned.withColumnsRenamed({"source": "source_", "size": "size_"}), seed)
    store.discard(histogram, planned)
    none = F.lit(0).cast("long")
    empty = sized.where("size = 0").select("*", none.alias("repeats"), none.alias("once"))
    return chosen.unionByName(empty.join(aimed.hint("merge"), empty.source.eqNullSafe(aimed.source_)).drop("source_"))


def mix(documents: DataFrame, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The query's contract: how many words of each document the mix takes.

    Also returns ``source`` and ``copies``, how often the document is taken.
    """
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("turn")
    every = drawn(documents, max_repeats, seed).select("*", turn)
    copies = F.col("repeats") + (F.col("turn") <= F.col("once")).cast("long")
    return every.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies")
    )


def sample(documents: DataFrame, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: documents that are taken, each with ``copies``, how often.

    Documents are found again by a hash of the row. Equal rows become one, which
    is given out as often as there are, with the copies of all of them dealt evenly.
    """
    documents = documents.drop("copies")
    names = documents.columns
    key, rows, repeats, once, turn = (store.fresh(names, f"mix_{x}") for x in ("key", "rows", "repeats", "once", "turn"))
    taken = drawn(documents, max_repeats, seed).where("repeats + once > 0")
    taken = taken.select("row_key", "rows", "repeats", "once").toDF(key, rows, repeats, once)
    met = documents.withColumn(key, row_key(documents)).join(taken, key)
    columns = [F.col(f"`{c}`") for c in names]
    single = met.where(F.col(rows) == 1).select(*columns, (F.col(repeats) + F.col(once)).cast("int").alias("copies"))
    again = met.where(F.col(rows) > 1).groupBy(key, rows, repeats, once).agg(F.any_value(F.struct(*columns)).alias(turn + "row"))
    again = again.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rows))))
    copies = F.col(repeats) + (F.col(turn) <= F.col(once)).cast("long")
    again = again.select(f"{turn}row.*", copies.cast("int").alias("copies")).where(F.col("copies") > 0)
    return single.unionByName(again)


#: Sizes and targets in DuckDB SQL: each round caps the sources above their limit and shares the rest by weight.
ORACLE_TARGETS = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source
), walk(i, source, s, w, capped) AS (
  SELECT 0, source, s, w, false FROM sizes
  UNION ALL
  SELECT i + 1, source, s, w, capped OR w * level > 3 * s + 1e-9 FROM (
    SELECT *, (sum(s) OVER () - sum(CASE WHEN capped THEN 3 * s ELSE 0 END) OVER ())::DOUBLE
      / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) AS level FROM walk
  ) WHERE i < (SELECT count(*) FROM sizes)
), last AS (SELECT * FROM walk WHERE i = (SELECT count(*) FROM sizes)
), targets AS (
  SELECT source, s, CASE WHEN capped THEN 3.0 * s ELSE w * (sum(s) OVER () - sum(CASE WHEN capped THEN 3 * s ELSE 0 END) OVER ())::DOUBLE
    / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) END AS target FROM last
)
SELECT doc_id, size, s AS source_size, round(target::DOUBLE, 4) AS target FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
"""
