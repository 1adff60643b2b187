"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is its multiset of five-word shingles (words as in `decontaminate`),
weighted 1 + ln(multiplicity). Each shingle emits a Poisson process of arrivals
with its weight as rate, every arrival at a random register; a register keeps the
shingle that arrives first, and a shingle stops once its next arrival is later
than all registers (Ertl, 2020). Registers of two documents agree with the
probability Jaccard similarity of their weighted shingles.

Documents with the same word sequence collapse into one representative before
anything else, so large groups of copies cost one row. Bands of ROWS registers
bring representatives together in buckets. In a bucket, members are compared
with one centre, the member that meets most others over all its buckets, so a
group of near copies needs one comparison each. Links are verified on the full
shingle sets: the larger of Jaccard and probability Jaccard must reach
``similarity``. After connected components over these links, members of buckets
that hold several components are compared with each other where prefix
filtering, by number for Jaccard and by weight for probability Jaccard, allows a
link; both filters are exact, so no link is lost to the choice of the centre, no
bucket is ever held by one task, and large groups of copies that are not near
each other do not meet.

Bands and rows follow from ``similarity``: as many rows a band as MOST_REGISTERS
allow while a pair at that similarity is missed less often than MISS.

Defined results: null and wordless texts, and rows with a null id, are classes
of their own (a null id has a null class). A class is named by its least doc_id.
Repeated rows are copies of each other; rows that repeat an id with other texts are
documents of their own, of their own classes. Texts of any length are read whole.
``classes`` ignores extra columns, ``deduplicate`` passes them through, whatever
their names. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb
from .decontaminate import SHINGLE
from .language_id import lowered

MISS, MOST_REGISTERS = 5e-5, 160
BLOCK = 1 << 21
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def banding(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows a band."""
    found = (math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-9))), 1)
    for rows in range(2, MOST_REGISTERS):
        bands = math.ceil(math.log(miss) / math.log1p(-min(similarity**rows, 1 - 1e-9)))
        if bands * rows > MOST_REGISTERS:
            break
        found = (bands, rows)
    return found


def registers(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, size: int = 125) -> np.ndarray:
    """``size`` packed registers (arrival time, shingle) of each document, by vectorised arrival rounds."""
    table = np.full(n_docs * size, EMPTY, tb.U64)
    name = tb.mix(value + tb.U64(0x5851F42D4C957F2D)) >> tb.U64(32)
    at, arrival, turn = np.arange(len(value)), np.zeros(len(value)), 0
    while len(at):
        turn += 1
        r = tb.mix(value[at] + tb.U64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        arrival = arrival - np.log(((r >> tb.U64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[at]
        time = arrival.astype(np.float32).view(np.uint32).astype(tb.U64) << tb.U64(32)
        slot = ((r & tb.U64(0xFFFF)) * tb.U64(size) >> tb.U64(16)).astype(np.int64)
        np.minimum.at(table, owner[at] * size + slot, time | name[at])
        last = table.reshape(n_docs, size).max(axis=1)
        open_ = time <= last[owner[at]]
        at, arrival = at[open_], arrival[open_]
    return table.reshape(n_docs, size)


def sketch(batch: pa.RecordBatch, bands: int = 25, rows: int = 5) -> dict[str, pa.Array]:
    """Class digest, band keys and sorted shingles of each text."""
    n = batch.num_rows
    raw, offsets = tb.utf8(lowered(batch.column("text")))
    starts, ends, docs = tb.words(raw, offsets, tb.symbol_table())
    hashes = tb.range_hashes(raw, starts, ends)
    count = np.bincount(docs, minlength=n)
    filled = count > 0
    # The digest is a polynomial over the words of each document, in two independent halves.
    digests = []
    for base in (tb.BASE, np.uint64(0xA24BAED4963EE407)):
        place = np.arange(len(docs)) - np.repeat(np.cumsum(count) - count, count)
        total = np.zeros(n, tb.U64)
        np.add.at(total, docs, tb.mix(hashes + base) * tb.powers(int(count.max(initial=0)), base)[place])
        digests.append(tb.mix(total + count.astype(tb.U64)).view(np.int64))
    value, owner = tb.shingles(hashes, docs, SHINGLE, n)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(value)))
    packed = registers(value[first], owner[first], 1 + np.log(times), n, bands * rows)
    name = packed & np.uint64(0xFFFFFFFF)
    keys = np.zeros((n, bands), tb.U64)
    for j in range(rows):
        keys = keys * tb.BASE + name.reshape(n, bands, rows)[:, :, j]
    keys = tb.mix(keys + np.arange(1, bands + 1, dtype=tb.U64) * tb.GOLDEN).view(np.int64)
    shingle_counts = np.bincount(owner, minlength=n)
    blob = (value >> np.uint64(32)).astype("<u4").tobytes()
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(4 * shingle_counts, out=bounds[1:])
    blank = pa.array(~filled)
    banded = tb.lists(keys.ravel(), np.full(n, bands), pa.int64())
    import pyarrow.compute as pc

    return {
        "d1": pa.array(digests[0], mask=~filled),
        "d2": pa.array(digests[1], mask=~filled),
        "keys": pc.if_else(blank, pa.scalar(None, banded.type), banded),
        "shingles": pa.array([blob[bounds[i] : bounds[i + 1]] for i in range(n)], pa.binary()),
    }


def sketches(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in tb.blocks(batches, "text", BLOCK):
            out = {
                "rid": pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64)),
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "same": batch.column("same"),
            } | sketch(batch, bands, rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


SKETCH = "rid long, doc_id long, same long, d1 long, d2 long, keys array<long>, shingles binary"


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two weight vectors over the same shingles (0 where absent)."""
    both = np.flatnonzero((x > 0) & (y > 0))
    if not len(both):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    above = np.append(np.cumsum(x[order][::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(y[order]))
    cut = np.searchsorted(ratio[order], ratio[both], side="right")
    return float((1 / (above[cut] / x[both] + below[cut] / y[both])).sum())


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sorted shingle multisets are near: Jaccard first, weights only if they can matter."""
    u, n_u = np.unique(np.frombuffer(a, "<u4"), return_counts=True)
    v, n_v = np.unique(np.frombuffer(b, "<u4"), return_counts=True)
    if not len(u) or not len(v):
        return False
    shared = np.intersect1d(u, v, assume_unique=True)
    jaccard = len(shared) / (len(u) + len(v) - len(shared))
    if jaccard >= similarity - 1e-9:
        return True
    if n_u.max() == 1 and n_v.max() == 1:
        return False
    every = np.union1d(u, v)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, u)] = 1 + np.log(n_u)
    y[np.searchsorted(every, v)] = 1 + np.log(n_v)
    return probability_jaccard(x, y) >= similarity - 1e-9


def verifier(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            ok = [similar(left[i].as_py(), right[i].as_py(), similarity) for i in range(batch.num_rows)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return run


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets, ``shingles(rid, shingles)``, are near."""
    left = shingles.select(F.col("rid").alias("a"), F.col("shingles").alias("left"))
    right = shingles.select(F.col("rid").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        verifier(similarity), "a long, b long"
    )


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct shingle of a document, with its weight, and their number and total weight."""
    for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
        sets, times = [], []
        for x in batch.column("shingles").to_pylist():
            value, often = np.unique(np.frombuffer(x, "<u4"), return_counts=True)
            sets.append(value)
            times.append(1 + np.log(often))
        counts = np.array([len(x) for x in sets], np.int64)
        total = np.array([x.sum() for x in times], np.float64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        weight = np.concatenate(times) if times else np.zeros(0)
        at = pa.array(np.repeat(np.arange(len(sets)), counts))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rid").take(at),
                batch.column("component").take(at),
                pa.array(np.repeat(counts, counts)),
                pa.array(every.view(np.int32)),
                pa.array(weight),
                pa.array(np.repeat(total, counts)),
            ],
            names=["rid", "component", "n", "shingle", "weight", "total"],
        )


def prefix_pairs(members: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components that can reach the similarity by either measure: an exact filter.

    With shingles in one global order, rarest first, two documents at Jaccard t
    share one of the first n - ceil(t n) + 1 of each, and from the first that they
    share enough must follow in both. Probability Jaccard is bounded likewise by
    weight: if the first that they share starts the last shares p and q of their
    total weights, it is at most 1 / (1 / p + 1 / q - 1), so p and q are at least t.
    Without repeated shingles both measures are one. Copies that differ much from all others start
    with shingles of their own and so meet nobody, however large their group;
    members of a shingle's largest component do not meet each other.
    """
    rows = store.shelve(
        shingles.join(members, "rid").select("rid", "component", "shingles").mapInArrow(
            shingle_rows, "rid long, component long, n long, shingle int, weight double, total double"
        ),
        "tokens",
    )
    shared = rows.groupBy("shingle").agg(F.count("*").alias("docs")).where("docs > 1")
    shared = store.shelve(shared, "frequencies")
    order = Window.partitionBy("rid").orderBy(F.coalesce("docs", F.lit(1)), "shingle")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    by_number = F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    head = store.shelve(
        rows.join(shared, "shingle", "left")
        .withColumn("rank", F.row_number().over(order))
        .withColumn("share", 1 - (upto - F.col("weight")) / F.col("total"))
        .where((by_number | (F.col("share") >= similarity - 1e-9)) & F.col("docs").isNotNull())
        .select("rid", "component", "shingle", "n", "rank", "share", (F.col("total") > F.col("n")).alias("repeats")),
        "prefixes",
    )
    share = head.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    split = share.groupBy("shingle").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
    split = store.shelve(split.where("parts > 1").select("shingle", F.col("top.component").alias("main")), "split")
    apart = store.shelve(head.join(split, "shingle"), "heads")
    side = lambda df, k, *more: df.select(
        "shingle", F.col("rid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("component", "n", "rank", "share", "repeats")], *more
    )
    minor, other = side(apart.where("component <> main"), "x"), side(apart, "y", "main")
    # Shingles in common, at most: this one, and what follows it in both.
    most = 1 + F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y"))
    enough = most >= (F.col("n_x") + F.col("n_y")) * (similarity / (1 + similarity)) - 1e-9
    heavy = 1 / F.col("share_x") + 1 / F.col("share_y") <= 1 + 1 / similarity + 1e-9
    enough = enough | ((F.col("repeats_x") | F.col("repeats_y")) & heavy)
    store.discard(rows, shared, head, split)
    return (
        minor.join(other, "shingle")
        .where(F.expr("component_x <> component_y and (component_y = main or x < y)") & enough)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def placed_classes(documents: DataFrame, similarity: float) -> DataFrame:
    """Every row's (doc_id, same, class): ``same`` is the hash of its text, classes are numbers (null: alone)."""
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("same"),
    )
    drawn = store.shelve(source.mapInArrow(sketches(*banding(similarity)), SKETCH), "sketches")
    usable = drawn.where("d1 is not null and doc_id is not null")
    alone = drawn.where("d1 is null or doc_id is null").select("doc_id", "same", F.lit(None).cast("long").alias("class"))
    alone = store.shelve(alone, "alone")
    reps = store.shelve(usable.groupBy("d1", "d2").agg(F.min("rid").alias("rep")), "copies")
    members = store.shelve(usable.select("doc_id", "same", "d1", "d2").join(reps, ["d1", "d2"]).select("doc_id", "same", "rep"), "members")
    own = store.shelve(
        drawn.select("rid", "keys").join(reps.select(F.col("rep").alias("rid")).hint("merge"), "rid"), "representatives"
    )
    store.discard(reps)
    banded = own.select("rid", F.explode("keys").alias("key"))
    met = store.shelve(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    bucket = store.shelve(banded.join(met, "key"), "met")
    centrality = store.shelve(bucket.groupBy("rid").agg(F.sum("n").alias("reach")), "reach")
    store.discard(own)
    # Ids by the document are joined by merging at every size, never broadcast.
    shingles = store.shelve(
        drawn.select("rid", "shingles").join(centrality.select("rid").hint("merge"), "rid"), "shingles"
    )
    store.discard(drawn)
    centre = store.shelve(
        bucket.join(centrality, "rid")
        .groupBy("key")
        .agg(F.max(F.struct(F.col("reach"), (-F.col("rid")).alias("least"))).alias("top"))
        .select("key", (-F.col("top.least")).alias("centre")),
        "centres",
    )
    star = store.shelve(
        bucket.join(centre, "key").where("rid <> centre").select(F.col("rid").alias("a"), F.col("centre").alias("b")).distinct(),
        "star",
    )
    links = store.shelve(verified(star, shingles, similarity), "links")
    found = store.components(links)
    named = store.shelve(found, "named")
    store.discard(found)
    # Members of buckets that hold several components meet by prefix filtering.
    label = bucket.join(named.withColumnRenamed("node", "rid"), "rid", "left").select(
        "key", "rid", F.coalesce("component", "rid").alias("component")
    )
    label = store.shelve(label, "labels")
    split = label.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    apart = store.shelve(label.join(split, "key", "left_semi").select("rid", "component").distinct(), "apart")
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = store.shelve(prefix_pairs(apart, shingles, similarity).join(tried, ["a", "b"], "left_anti"), "near")
    more = store.shelve(verified(near, shingles, similarity), "more")
    every = named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
        more.join(named.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(named.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    found = store.components(every)
    final = store.shelve(found, "classes")
    store.discard(found)
    placed = store.shelve(
        members.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
            "doc_id", "same", F.coalesce("component", "rep").alias("class")
        ),
        "placed",
    )
    store.discard(members, met, bucket, centrality, shingles, centre, star, links, named, label, apart, near, more, final)
    return placed.unionByName(alone)


def classes(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id and class_size."""
    placed = placed_classes(documents, similarity)
    named_by = store.shelve(
        placed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")),
        "sizes",
    )
    grouped = placed.where("class is not null").join(named_by, "class").select("doc_id", "class_id", "class_size")
    alone = placed.where("class is null")
    return grouped.unionByName(
        alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    )


def deduplicate(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each class, the one of least id (of several texts of that id the one of least hash).

    Of rows that repeat id and text one stays, the first as JSON. Rows with a null id stay.
    """
    names = documents.columns
    key, same, more = (store.fresh(names, x) for x in ("stay_id", "stay_text", "stay_more"))
    placed = placed_classes(documents, similarity).where("doc_id is not null")
    n = F.count("*").alias("n")
    alone = placed.where("class is null").groupBy("doc_id", "same").agg(n)
    grouped = placed.where("class is not null").groupBy("class", "doc_id", "same").agg(n)
    first = grouped.groupBy("class").agg(F.min(F.struct("doc_id", "same", "n")).alias("first")).select("first.*")
    stay = store.shelve(alone.unionByName(first).select("doc_id", "same", (F.col("n") > 1).alias("more")), "stay")
    keyed = documents.withColumn(key, F.col("doc_id").cast("long")).withColumn(same, F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(stay.toDF(key, same, more).hint("merge"), [key, same])
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    again = kept.where(F.col(more)).groupBy(key, same).agg(F.min_by(row, F.to_json(row)).alias(more)).select(f"{more}.*")
    once = kept.where(~F.col(more)).select(*[f"`{c}`" for c in names])
    return once.unionByName(again).unionByName(documents.where("doc_id is null"))
