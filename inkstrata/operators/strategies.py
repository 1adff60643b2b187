"""Minimal edits near a signal: a small lexicon, ranked by closeness, as bounded candidates, and a search over them.

Words, spans and edits are rows; a document's candidates are built in its own row
from its ranked edits. No candidate is trusted: the search keeps one only when the
quality checks pass and the detectors agree, and otherwise gives the source back.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from . import quality, spans

# Words and their plain replacements.
LEXICON = (
    ("additionally", "also"), ("approximately", "about"), ("commence", "begin"), ("demonstrate", "show"), ("demonstrates", "shows"),
    ("frequently", "often"), ("however", "yet"), ("nevertheless", "still"), ("numerous", "many"), ("perhaps", "maybe"),
    ("primarily", "mainly"), ("purchase", "buy"), ("regarding", "about"), ("therefore", "thus"), ("typically", "usually"),
    ("utilize", "use"), ("utilized", "used"), ("utilizes", "uses"),
)
# What is a word, and the bounds of spans, edits and candidates.
WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)?"
MOST_SPANS, MOST_EDITS, MOST_CANDIDATES = 4096, 3, 24


def replacement(word: Column) -> Column:
    """The plain word in the case of ``word`` (lower, upper or title); null for other words and other cases."""
    plain = F.try_element_at(F.create_map(*[F.lit(x) for pair in LEXICON for x in pair]), F.lower(word))
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))
    return (
        F.when(word == F.lower(word), plain)
        .when(word == F.upper(word), F.upper(plain))
        .when(word == title, F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20)))
    )


def span_rank() -> list[Column]:
    """Order of signal spans: least chance, greatest margin, place."""
    margin = F.when(F.col("score").isNull(), 0.0).otherwise(F.abs(F.col("score") - F.coalesce("threshold", F.lit(0.0))))
    return [F.coalesce("p_value", F.lit(1.0)).alias("p"), (-margin).alias("m"), F.col("start").alias("s"), F.col("end").alias("e")]


def plain_words(texts: DataFrame) -> DataFrame:
    """ASCII words with their places: doc_id, word_index, word, start, end."""
    between = F.split("text", WORD, -1)
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = texts.select("doc_id", F.posexplode(F.arrays_zip(found.alias("word"), between.alias("gap"))).alias("word_index", "w"))
    rows = rows.where("w.word is not null").select("doc_id", "word_index", "w.word", "w.gap")
    order = Window.partitionBy("doc_id").orderBy("word_index")
    end = F.sum(F.length("gap") + F.length("word")).over(order).cast("int")
    return rows.select("doc_id", "word_index", "word", (end - F.length("word")).alias("start"), end.alias("end"))


def ranked_edits(texts: DataFrame, signals: DataFrame, reach: int = 2) -> DataFrame:
    """Replacements within ``reach`` words of a signal, best first: doc_id, rank, start, end, original, replacement.

    signals(doc_id, start, end, score, p_value, threshold). A word's signal is the
    best of those it overlaps; an edit goes by distance to the nearest such word,
    that signal's rank, and its own length and place.
    """
    words = plain_words(texts)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end"))
    bounded = signals.where("start < end").withColumn("i_", first).where(F.col("i_") <= MOST_SPANS)
    ranked = bounded.select("doc_id", "start", "end", F.struct(*span_rank()).alias("signal"))
    runs = spans.touched(ranked, words, keep=True).join(ranked, ["doc_id", "start", "end"])
    token = runs.select("doc_id", "signal", F.explode(F.sequence("from", "to")).alias("at"))
    token = token.groupBy("doc_id", "at").agg(F.min("signal").alias("signal"))
    near = token.select("doc_id", "at", "signal", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("word_index"))
    near = near.groupBy("doc_id", "word_index").agg(
        F.min(F.struct(F.abs(F.col("at") - F.col("word_index")).alias("distance"), "signal", "at")).alias("near")
    )
    usable = words.withColumn("replacement", replacement(F.col("word"))).where("replacement is not null")
    size = F.greatest(F.length("word"), F.length("replacement"))
    order = Window.partitionBy("doc_id").orderBy("near.distance", "near.signal", size, "start")
    return usable.join(near, ["doc_id", "word_index"]).select(
        "doc_id", F.row_number().over(order).alias("rank"), "start", "end", F.col("word").alias("original"), "replacement"
    )


def edited(text: Column, edits: Column) -> Column:
    """``text`` after edits (start, end, replacement) that do not overlap, in any order."""

    def whole(listed: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(listed, i - 1)["end"]).otherwise(0)
        pieces = F.transform(listed, lambda e, i: F.concat(F.substring(text, before(i) + 1, e["start"] - before(i)), e["replacement"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(listed, -1)["end"] + 1, F.length(text)))

    from ..functions.bind import let

    return F.when(F.size(edits) > 0, let(whole, F.sort_array(edits))).otherwise(text)


def choices(n: Column, most_edits: int, limit: int) -> Column:
    """Sets of edit ranks to try, in order: the best one, two, ..., then all single ones, pairs, and so on."""
    k = F.least(n, F.lit(most_edits))
    prefixes = F.transform(F.sequence(F.lit(1), k), lambda i: F.sequence(F.lit(1), i))
    # No more of a size are built than can be taken, and larger sets grow from those.
    upto = F.sequence(F.lit(1), F.least(n, F.lit(limit + 1)))
    level = F.transform(upto, lambda i: F.array(i))
    out = [prefixes, level]
    for size in range(2, most_edits + 1):
        grown = F.transform(
            level,
            lambda s: F.transform(F.filter(upto, lambda i: i > F.element_at(s, -1)), lambda i: F.concat(s, F.array(i))),
        )
        level = F.slice(F.flatten(grown), 1, limit + most_edits)
        out.append(F.when(n >= size, level).otherwise(F.array().cast("array<array<int>>")))
    return F.slice(F.array_distinct(F.concat(*out)), 1, limit)


def candidates(texts: DataFrame, signals: DataFrame, reach: int = 2, most_edits: int = MOST_EDITS, limit: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates of each text: doc_id, text, candidate_index, candidate, n_edits. No text without a signal has any."""
    if not (0 <= reach <= 64 and 1 <= most_edits <= 16 and 1 <= limit <= 64):
        raise ValueError("reach, most_edits or limit is out of bounds")
    top = ranked_edits(texts, signals, reach).where(F.col("rank") <= limit + 1)
    listed = top.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "end", "replacement"))).alias("edits"))
    sets = texts.select("doc_id", "text").join(listed, "doc_id").withColumn("sets", choices(F.size("edits"), most_edits, limit))
    rows = sets.select("doc_id", "text", "edits", F.posexplode("sets").alias("candidate_index", "chosen"))
    picked = F.transform(
        "chosen",
        lambda r: F.struct(
            F.get("edits", r - 1)["start"].alias("start"), F.get("edits", r - 1)["end"].alias("end"), F.get("edits", r - 1)["replacement"].alias("replacement")
        ),
    )
    return rows.select("doc_id", "text", "candidate_index", edited(F.col("text"), picked).alias("candidate"), F.size("chosen").alias("n_edits"))


def _changed(source: str, candidate: str) -> int:
    if len(source) * len(candidate) > 4_000_000:  # one span from the first to the last difference
        least = min(len(source), len(candidate))
        head = next((i for i in range(least) if source[i] != candidate[i]), least)
        tail = next((i for i in range(least - head) if source[-1 - i] != candidate[-1 - i]), least - head)
        return max(len(source), len(candidate)) - head - tail
    codes = SequenceMatcher(a=source, b=candidate, autojunk=False).get_opcodes()
    return sum(max(z - a, y - b) for tag, a, z, b, y in codes if tag != "equal")


@F.pandas_udf(T.IntegerType())
def edit_characters(source: pd.Series, candidate: pd.Series) -> pd.Series:
    """Characters changed between two texts; pairs too large to align count as one changed span."""
    return pd.Series([None if a is None or b is None else _changed(a, b) for a, b in zip(source, candidate, strict=True)], dtype="Int32")


def node_order() -> list[Column]:
    """Order of candidates: cleared before detected before all else, then margin, changed characters, hash."""
    status = F.when(F.col("status") == "not_detected", 0).when(F.col("status") == "detected", 1).otherwise(2)
    return [status, F.coalesce("margin", F.lit(float("inf"))), F.col("edit_characters"), F.sha2(F.col("candidate").cast("binary"), 256)]


Detector = Callable[[DataFrame, str], DataFrame]
Strategy = Callable[[DataFrame], DataFrame]


def mitigate(texts: DataFrame, detector: Detector, strategies: list[Strategy], verifier: Detector | None = None, rounds: int = 2, beam: int = 4) -> DataFrame:
    """A search for the least edit that clears the detector: doc_id, outcome, text, n_rounds, edit_characters.

    ``detector`` adds status and margin; a strategy turns (doc_id, text) into
    candidates (doc_id, text, candidate), where doc_id names a node of the search. The
    frontier is a table of nodes, the ``beam`` best of each document. In each round
    their candidates, less all that the document has seen in any round, are checked for
    quality against the source and scored; the round is then a table of its own, so
    nothing is computed twice and no plan grows with the rounds. A round without new
    nodes is the last. The best cleared candidate is checked by ``verifier``; without
    one that holds, the outcome is ``rolled_back`` and the text is the source.
    """
    if rounds < 1 or beam < 1 or not strategies:
        raise ValueError("a search takes a round, a place in the beam and a strategy at least")
    mark = F.sha2(F.col("candidate").cast("binary"), 256)
    scored = shared.kept(detector(texts.select("doc_id", "text"), "text").select("doc_id", "text", "status"), "scored")
    marked = scored.where("status = 'detected'").select("doc_id", F.col("text").alias("source"))
    nodes = marked.select("doc_id", F.col("source").alias("text"))
    seen = marked.select("doc_id", F.sha2(F.col("source").cast("binary"), 256).alias("mark"))
    levels = []
    for turn in range(1, rounds + 1):
        node = F.concat_ws(":", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.sha2(F.col("text").cast("binary"), 256))
        front = nodes.withColumn("node", node)
        made = None
        for strategy in strategies:
            part = strategy(front.select(F.col("node").alias("doc_id"), "text")).select(F.col("doc_id").alias("node"), "candidate")
            made = part if made is None else made.unionByName(part)
        made = made.join(front.select("node", "doc_id"), "node").select("doc_id", "candidate").where("candidate is not null")
        fresh = made.withColumn("mark", mark).dropDuplicates(["doc_id", "mark"]).join(seen, ["doc_id", "mark"], "left_anti")
        fresh = shared.kept(fresh, "candidates")
        # A filter on a report itself would be pushed below it, with all its expressions written out again for each use.
        judged = quality.evaluate(fresh.drop("mark").join(marked, "doc_id")).select("doc_id", "source", "candidate", "passed")
        good = shared.kept(judged, "judged").where("passed").drop("passed")
        rated = detector(good, "candidate").select("doc_id", "source", "candidate", "status", "margin")
        rated = rated.withColumn("edit_characters", edit_characters("source", "candidate"))
        best = F.row_number().over(Window.partitionBy("doc_id").orderBy(*node_order()))
        level = shared.kept(rated.withColumn("place", best).where(F.col("place") <= beam).withColumn("n_rounds", F.lit(turn)), "level")
        levels.append(level)
        nodes = level.where("status <> 'not_detected'").select("doc_id", F.col("candidate").alias("text"))
        seen = seen.unionByName(fresh.select("doc_id", "mark"))
        if nodes.isEmpty():
            break
    cleared = reduce(DataFrame.unionByName, levels).where("status = 'not_detected'")
    if verifier is not None:
        checked = verifier(cleared.drop("status", "margin"), "candidate")
        cleared = checked.where("status = 'not_detected'")
    least = Window.partitionBy("doc_id").orderBy("n_rounds", "edit_characters", mark)
    won = cleared.withColumn("first", F.row_number().over(least)).where("first = 1").select("doc_id", "candidate", "n_rounds", "edit_characters")
    out = scored.join(won, "doc_id", "left")
    outcome = F.when(F.col("status") != "detected", "not_detected").when(F.col("candidate").isNull(), "rolled_back").otherwise("cleared")
    return out.select("doc_id", outcome.alias("outcome"), F.coalesce("candidate", "text").alias("text"), "n_rounds", "edit_characters")


def estimate_green(token_scores: DataFrame, quantile: float) -> DataFrame:
    """Token ids whose surprisal reaches the order statistic at int(n quantile) of their document: doc_id, token_id."""
    order = Window.partitionBy("doc_id").orderBy("surprisal_bits")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    ranked = token_scores.withColumn("r_", F.row_number().over(order) - 1).withColumn("n_", n)
    cut = F.max(F.when(F.col("r_") == F.least(F.col("n_") - 1, F.floor(F.col("n_") * quantile)), F.col("surprisal_bits")))
    limit = cut.over(Window.partitionBy("doc_id"))
    return ranked.withColumn("cut_", limit).where("surprisal_bits >= cut_").select("doc_id", "token_id").distinct()
