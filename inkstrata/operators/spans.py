"""Text chunks and character spans: packing, selection by score, merging, templates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import places
from ..functions import unicode_data as U
from ..functions.rounding import exact_round
from ..functions.unicode_data import SPACE


def chunk(text: Column, most: int) -> Column:
    """Greedy packing of sentence and paragraph parts into chunks of at most ``most`` characters, losslessly."""
    marked = F.regexp_replace(text, rf"(\n{SPACE}*\n|(?<=[.!?])(?={SPACE}))", "$1\x00")
    parts = F.filter(F.split(marked, "\x00"), lambda p: p != "")
    pieces = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")),
                lambda i: F.substring(p, i * most + 1, F.lit(most)),
            ),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, piece: Column) -> Column:
        fits = F.length(state["now"]) + F.length(piece) <= most
        return F.struct(
            F.when(fits | (state["now"] == ""), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"),
            F.when(fits, F.concat(state["now"], piece)).otherwise(piece).alias("now"),
        )

    end = lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(pieces, start, step, end))


def split(text: Column, most: int, cutter=None) -> Column:
    """Chunks by ``cutter`` (text and size to an array), or the built-in ones; null where they do not make the text again."""
    parts = (cutter or chunk)(text, most)
    return F.when(F.array_join(parts, "") == text, parts)


def unprotected(token: Column) -> Column:
    """Tokens that may be selected: with a letter and without a digit."""
    return token.rlike(r"\p{L}") & ~token.rlike(r"\p{Nd}")


def select_top(token_scores: DataFrame, share: float, most: int = 96) -> DataFrame:
    """The top share of unprotected tokens by score, one at least, ``most`` at most; ties by position.

    token_scores(doc_id, token_id, token_str, start, end, surprisal_bits).
    """
    usable = token_scores.where(unprotected(F.col("token_str")) & (F.col("end") > F.col("start")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("surprisal_bits"), "start"))
    # With this bound alone beside the rank, Spark drops the rest before it shuffles; counts are made ahead of it, too.
    ranked = usable.withColumn("rank", rank).where(F.col("rank") <= most)
    k = F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.count("*") * share).cast("int")))
    counts = usable.groupBy("doc_id").agg(k.alias("k"))
    met = ranked.join(counts, "doc_id")
    return met.where("rank <= k").select("doc_id", "token_id", "start", "end", "surprisal_bits")


def score_summary(token_scores: DataFrame, heavy: float = 8.0) -> DataFrame:
    return token_scores.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        exact_round(F.avg("surprisal_bits"), 3).alias("mean_bits"),
        exact_round(F.avg((F.col("surprisal_bits") >= heavy).cast("double")), 3).alias("heavy_share"),
    )


def pieces_of(text: Column) -> Column:
    """Blank-separated words, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(f"{SPACE}*[^{SPACE[1:-1]}]+"), F.lit(0))


def word_places(texts: DataFrame) -> DataFrame:
    """The words of each text with their places as arrays in its row: doc_id, words, starts, ends."""
    found = texts.select("doc_id", pieces_of(F.col("text")).alias("pieces_"))
    found = found.select(
        "doc_id",
        F.transform("pieces_", lambda p: F.regexp_replace(p, f"^{SPACE}+", "")).alias("words"),
        places.running(F.transform("pieces_", F.length)).alias("ends"),
    )
    return found.select("doc_id", "words", F.zip_with("words", "ends", lambda w, e: e - F.length(w)).alias("starts"), "ends")


def word_spans(texts: DataFrame) -> DataFrame:
    """Blank-separated words with their places: doc_id, word_index, word, start, end."""
    held = word_places(texts).select("doc_id", F.posexplode(F.arrays_zip("words", "starts", "ends")).alias("word_index", "w"))
    place = lambda c: F.col(f"w.{c}s").cast("long").alias(c)
    return held.select("doc_id", "word_index", F.col("w.words").alias("word"), place("start"), place("end"))


def touched(spans: DataFrame, words: DataFrame, keep: bool = False) -> DataFrame:
    """The first and last word that each span touches: doc_id, from, to; with ``keep`` for each span, start and end.

    The first is as many words in as end before the span, the last one less than
    begin before its end: counts along the sorted places, not a join on ranges.
    """
    wide = spans.where("start < end").select("doc_id", "start", "end").distinct()
    place = lambda df, at, kind: df.select("doc_id", F.col(at).alias("at"), F.lit(kind).alias("kind"))
    order = Window.partitionBy("doc_id", "side").orderBy("at", "kind")
    # Words come before spans where they end at a span's start, and after them where they begin at its end.
    starts = place(words, "end", 0).withColumn("other", F.lit(None).cast("int")).unionByName(
        wide.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("other"))
    )
    ends = place(words, "start", 1).withColumn("other", F.lit(None).cast("int")).unionByName(
        wide.select("doc_id", F.col("end").alias("at"), F.lit(0).alias("kind"), F.col("start").alias("other"))
    )
    both = starts.withColumn("side", F.lit(0)).unionByName(ends.withColumn("side", F.lit(1)))
    rows = F.count_if(F.col("other").isNull()).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumn("rank", rows).where(F.col("other").isNotNull())
    first, last = F.col("side") == 0, F.col("side") == 1
    start, end = F.when(first, F.col("at")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("at"))
    found = (
        seen.groupBy("doc_id", start.alias("start"), end.alias("end"))
        .agg(F.max(F.when(first, F.col("rank"))).alias("from"), (F.max(F.when(last, F.col("rank"))) - 1).alias("to"))
        .where(F.col("from") <= F.col("to"))
    )
    return found if keep else found.select("doc_id", "from", "to").distinct()


def placed(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Runs of words (doc_id, from, to) as spans."""
    first = words.select("doc_id", F.col("word_index").alias("from"), "start")
    last = words.select("doc_id", F.col("word_index").alias("to"), "end")
    return runs.join(first, ["doc_id", "from"]).join(last, ["doc_id", "to"]).select("doc_id", "start", "end")


def snap(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Spans widened to the words that they touch."""
    return placed(touched(spans, words), words).distinct()


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(SPANS)
def islands(starts: pa.Array, ends: pa.Array, begins: pa.Array, stops: pa.Array) -> pa.Array:
    """Spans (begins, stops) of a text snapped to its words (starts, ends) and merged, in order."""
    firsts, lasts, sizes = [], [], [0]
    for row in zip(starts, ends, begins, stops, strict=True):
        a, z, b, e = (np.asarray(x.values if x.is_valid else [], np.int64) for x in row)
        first, last = np.searchsorted(z, b, "right"), np.searchsorted(a, e, "left") - 1
        held = first <= last
        order = np.lexsort((last[held], first[held]))
        first, last = first[held][order], last[held][order]
        reach = np.maximum.accumulate(last)
        fresh = np.flatnonzero(np.r_[True, first[1:] > reach[:-1] + 1][: len(first)])
        firsts.append(a[first[fresh]])
        lasts.append(z[reach[np.r_[fresh[1:] - 1, len(first) - 1][: len(fresh)]]])
        sizes.append(len(fresh))
    flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (firsts, lasts)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.StructArray.from_arrays(flat, names=["start", "end"]))


def merge(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Word-snapped spans, merged over overlaps and over gaps of white space.

    ``words`` are those of ``word_spans``, or of ``word_places``, which spares grouping
    them. A text's spans meet the places of its words in one row.
    """
    if "starts" not in words.columns:
        listed = F.sort_array(F.collect_list(F.struct("start", "end")))
        words = words.groupBy("doc_id").agg(listed.alias("w_")).select("doc_id", F.col("w_.start").alias("starts"), F.col("w_.end").alias("ends"))
    given = spans.where("start < end").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("s_"))
    met = given.join(words.select("doc_id", "starts", "ends"), "doc_id")
    found = met.select("doc_id", islands(F.col("starts"), F.col("ends"), F.col("s_.start"), F.col("s_.end")).alias("found_"))
    return found.select("doc_id", F.explode("found_").alias("f_")).select("doc_id", "f_.start", "f_.end")


def template(texts: DataFrame, spans: DataFrame, blank: str = "[BLANK]") -> DataFrame:
    """Texts with each span replaced by a placeholder."""
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans_"))
    pieces = F.transform(
        "spans_",
        lambda s, i: F.concat(
            F.substring(F.col("text"), F.coalesce(F.get("spans_", i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get("spans_", i - 1)["end"], F.lit(0))),
            F.lit(blank),
        ),
    )
    rest = F.substring(F.col("text"), F.element_at("spans_", -1)["end"] + 1, F.length("text"))
    whole = F.concat(F.array_join(pieces, ""), rest)
    return texts.join(listed, "doc_id", "left").select(
        "doc_id", F.coalesce(whole, F.col("text")).alias("template"), F.coalesce(F.size("spans_"), F.lit(0)).alias("n_blanks")
    )


LETTER, DIGIT, BLANK = 1, 2, 4
BLANKED = "struct<template:string,n:int>"


def cut(cps: np.ndarray, stop: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that end at ``stop``: where each begins and ends, and in which text."""
    begin = np.r_[0, stop][:-1]
    full = stop > begin
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    first[begin[full]], last[stop[full] - 1] = ~blank[begin[full]], ~blank[stop[full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(stop, starts, "right")


def best(row: np.ndarray, score: np.ndarray, texts: int, share: float, most: int) -> np.ndarray:
    """The words (texts ``row``, in order) that ``select_top`` takes, in order."""
    n = np.bincount(row, minlength=texts)
    k = np.minimum(most, np.maximum(1, np.rint(n * share))).astype(np.int64)
    order = np.lexsort((-score, row))
    rank = np.arange(len(row)) - np.r_[0, np.cumsum(n)][row]
    return np.sort(order[rank < k[row]])


def blanker(score: Callable[[np.ndarray], np.ndarray], share: float, most: int, blank: str):
    """An Arrow UDF of texts to templates and how many blanks they have."""
    kinds = {LETTER: U.ranges_of(lambda cp, category: category[0] == "L"), DIGIT: U.ranges_of(lambda cp, category: category == "Nd"), BLANK: places.BLANKS}
    known = [(bit, a, b) for bit, runs in kinds.items() for a, b in runs]
    signs = [ord(c) for c in blank]
    # By name, as the module itself cannot go to a worker.
    classes, slices, split_up, joined = places.classes, places.slices, places.split_up, places.joined

    @F.arrow_udf(BLANKED)
    def blanked(texts: pa.Array) -> pa.Array:
        of = classes(known)
        parts, counts = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
        for data, ends in slices(texts):
            cps, _, stop = split_up(data, ends)
            held = of[cps]
            a, z, row = cut(cps, stop, held & BLANK != 0)
            has = lambda bit: np.r_[0, np.cumsum(held & bit != 0)]
            letters, digits = has(LETTER), has(DIGIT)
            free = np.flatnonzero((letters[z] > letters[a]) & (digits[z] == digits[a]))
            number = free - np.searchsorted(row, row[free])
            word = free[best(row[free], score(number), len(ends), share, most)]
            fresh = np.r_[True, (np.diff(word) > 1) | (np.diff(row[word]) > 0)][: len(word)]
            first, last = a[word[fresh]], z[word[np.r_[fresh[1:], True][: len(word)]]]
            steps = np.zeros(len(cps) + 1, np.int64)
            steps[first] += 1
            steps[last] -= 1
            many = (np.cumsum(steps[:-1]) == 0).astype(np.int64)
            many[first] = len(signs)
            passed = np.r_[0, np.cumsum(many)]
            out = np.repeat(cps, many)
            for i, sign in enumerate(signs):
                out[passed[first] + i] = sign
            parts.append(joined(out, passed[stop]))
            counts.append(np.bincount(row[word[fresh]], minlength=len(ends)))
        columns = [pa.concat_arrays(parts), pa.array(np.concatenate(counts).astype(np.int32))]
        return pa.StructArray.from_arrays(columns, names=["template", "n"], mask=texts.is_null())

    return blanked


def top_templates(
    texts: DataFrame, score: Callable[[np.ndarray], np.ndarray], share: float, most: int = 96, blank: str = "[BLANK]"
) -> DataFrame:
    """``template`` of the merged top words (``select_top``) of each text, in its row: nothing is shuffled.

    ``score`` gives words their scores by their numbers in their texts, as arrays; scores that come
    as a table go through ``select_top``. A key names one text; one without a key stays as it is.
    """
    told = blanker(score, share, most, blank)(F.when(F.col("doc_id").isNotNull(), F.col("text")))
    held = texts.select("doc_id", "text", told.alias("told_"))
    return held.select("doc_id", F.coalesce("told_.template", "text").alias("template"), F.coalesce("told_.n", F.lit(0)).alias("n_blanks"))
