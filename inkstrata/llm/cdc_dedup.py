"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes decides where chunks end: the hash
must lie in the lowest 1/RARITY of its range, at least MIN_BYTES after the last
cut and at most MAX_BYTES, and never inside a UTF-8 character. Cuts depend on
nearby bytes only, so an insertion moves the chunks it touches and no others.
Chunks are deduplicated by a 128-bit digest. A chunk that several documents hold is
kept by the one of least id, its keeper. Neighbouring chunks that are repeated form
a region, and regions of ``min_chars`` or more are reported for every document that
holds them, as spans of chunks with one keeper. So the keeper of a span holds all of
its text, in spans that are ``is_first``, and whoever drops all spans that are not
first leaves each repeated chunk in its keeper. With ``within``, chunks that one
document alone repeats count too, and only the first in the keeper is first.

Digests are counted with partial aggregation, so a passage that a third of all
documents share is one row a task; occurrences are joined to the shelved table
of repeated digests, whose hot keys adaptive execution can split.

Defined results: null and empty texts, and rows with a null id, have no spans;
rows that repeat an id are one document, so what only they share is not
reported, and each of them keeps it. Texts shorter than a chunk are one chunk, texts
of any length are cut whole. Extra columns are ignored, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import textbatch as tb

BLOCK = 1 << 21
WINDOW = 16
RARITY, MIN_BYTES, MAX_BYTES = 20, 16, 256


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes that end at each position: sum of table[b] << age, by doubling."""
    table = (tb.mix(np.arange(1, 257, dtype=tb.U64) * tb.GOLDEN) >> tb.U64(32)).astype(np.uint32)
    h, span = table[raw], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and documents of all chunks."""
    n = len(raw)
    follows = np.zeros(n, bool)
    follows[:-1] = (raw[1:] & 0xC0) != 0x80
    cut = (gear(raw) < np.uint32(0xFFFFFFFF // RARITY)) & follows
    candidates = np.flatnonzero(cut) + 1
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    bounds = np.searchsorted(candidates, np.stack([offsets[:-1] + WINDOW, np.maximum(offsets[1:], offsets[:-1] + WINDOW)]))
    positions, places = candidates.tolist(), offsets.tolist()
    for doc in range(len(counts)):
        last, stop, before = places[doc], places[doc + 1], len(ends)
        for c in [*positions[bounds[0][doc] : bounds[1][doc]], stop]:
            if c > stop:
                continue
            while c - last > MAX_BYTES:
                last += MAX_BYTES
                while last < stop and not follows[last - 1]:
                    last += 1
                ends.append(last)
            if c - last >= MIN_BYTES or (c == stop and c > last):
                ends.append(c)
                last = c
        counts[doc] = len(ends) - before
    end = np.array(ends, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.empty_like(end)
    start[1:] = end[:-1]
    first = np.cumsum(counts) - counts
    start[first[counts > 0]] = offsets[:-1][counts > 0]
    return start, end, owner


def again(d1: np.ndarray, d2: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the same document has an equal chunk before."""
    order = np.lexsort((np.arange(len(d1)), d2, d1, owner))
    out = np.zeros(len(d1), bool)
    out[order[1:]] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (d1, d2, owner)])
    return out


def chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their digest, a row key, and in ``place`` whether it is a repetition (bit 62), start and end."""
    from pyspark import TaskContext

    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in tb.blocks(batches, "text", BLOCK):
        raw, offsets = tb.utf8(batch.column("text"))
        start, end, owner = chunks(raw, offsets)
        points = tb.code_points(raw)
        base = points[offsets[owner]]
        d1, d2 = (tb.range_hashes(raw, start, end, seed).view(np.int64) for seed in (1, 2))
        place = again(d1, d2, owner).astype(np.int64) << 62 | (points[start] - base) << 31 | (points[end] - base)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(d1),
                pa.array(d2),
                batch.column("doc_id").cast(pa.int64()).take(pa.array(owner)),
                pa.array(owner + row),
                pa.array(place),
            ],
            names=["d1", "d2", "doc_id", "rid", "place"],
        )
        row += batch.num_rows


def repeated_spans(documents: DataFrame, min_chars: int = 100, within: bool = False) -> DataFrame:
    """Spans of repeated text: doc_id, start, end, n_copies (the most of a chunk), first_doc_id, is_first."""
    source = documents.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = source.mapInArrow(chunker, "d1 long, d2 long, doc_id long, rid long, place long")
    repeated = store.shelve(
        found.groupBy("d1", "d2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("n > 1" if within else "least <> most")
        .select("d1", "d2", "n", "least"),
        "digests",
    )
    bits = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    first = F.col("least") == F.col("doc_id")
    held = found.join(repeated, ["d1", "d2"]).select(
        "rid",
        "doc_id",
        bits(31).alias("start"),
        bits(0).alias("end"),
        "n",
        "least",
        (first & (F.shiftright("place", 62) == 0) if within else first).alias("is_first"),
    )
    order = Window.partitionBy("rid").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    apart = F.coalesce(F.col("start") != before("end"), F.lit(True))
    other = apart | (F.col("least") != before("least")) | (F.col("is_first") != before("is_first"))
    spans = (
        held.withColumn("apart", apart.cast("int"))
        .withColumn("other", other.cast("int"))
        .withColumn("region", F.sum("apart").over(order))
        .withColumn("span", F.sum("other").over(order))
        .groupBy("rid", "region", "span")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max("n").alias("n_copies"),
            F.min("least").alias("first_doc_id"),
            F.bool_and("is_first").alias("is_first"),
        )
    )
    whole = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("rid", "region"))
    return spans.withColumn("whole", whole).where(F.col("whole") >= min_chars).drop("rid", "region", "span", "whole")
