"""Inspection of covert Unicode: occurrences, findings and document reports.

Texts are screened with one regular expression; only those with a flagged
character are taken apart, inside their own row. Nothing is shuffled before
occurrences are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from ..functions import unicode_data as U
from ..functions.bind import let

SKIPPED = r"\x{200C}\x{200D}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"


def mapped(table: dict[str, str], ch: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair]), ch)


def in_class(ch: Column, inside: str) -> Column:
    return ch.rlike(f"[{inside}]")


def script_of(ch: Column) -> Column:
    """Script of one character; Common, Inherited or Other where names tell none."""
    out = F.when(in_class(ch, U.marks()), "Inherited").when(in_class(ch, letters()), "Other").otherwise("Common")
    for script, inside in U.scripts().items():
        out = F.when(in_class(ch, inside), script).otherwise(out)
    return out


def letters() -> str:
    return U.char_class(U.ranges_of(lambda cp, category: category[0] == "L"))


def grapheme_pattern() -> str:
    regional = r"\x{1F1E6}-\x{1F1FF}"
    joining = r"\x{300}-\x{10FFFF}&&[" + U.marks() + SKIPPED + r"\x{1F3FB}-\x{1F3FF}\x{E0000}-\x{E007F}\x{20E3}]"
    return rf"(?s)(?:[{regional}]{{2}}|.)(?:[{joining}]|(?<=\x{{200D}})[^{regional}])*"


def hits(text: Column, graphemes: bool = False, letters: bool = True) -> Column:
    """The flagged characters of a text in order, with places and verdicts, as an array in its row; null without one.

    ``kind`` is the row of ``flagged_table``. An Arrow UDF over batches: places are
    array arithmetic, so the cost goes with the text and not with hits times text.
    """
    return places.finder(graphemes, letters)(F.when(text.rlike(f"[{U.flagged_class(letters)}]"), text))


def said(verdict: Column, i: int) -> Column:
    """The disposition (0) or the context (1) that a verdict stands for."""
    return F.get(F.array(*[F.lit(v[i]) for v in places.VERDICTS]), verdict)


def occurrences(
    texts: DataFrame,
    key: str = "doc_id",
    column: str = "text",
    offsets: bool = True,
    graphemes: bool = False,
    lines: bool = False,
    letters: bool = True,
    heads: Column | None = None,
) -> DataFrame:
    """One row for each flagged character of each text, with its context and disposition.

    key, position (code points), byte_offset, grapheme_index, line, column, ch,
    codepoint, name, category, action, safe_rule, token, disposition, context.
    Offsets, grapheme indices and lines are null without ``offsets``, ``graphemes`` and
    ``lines``. Without ``letters``, look-alikes are left out: they are no policy edits.
    ``heads``, an array with a value for each line of the text, adds ``head``, that of
    the hit's line. Rows stay where their text is: nothing is shuffled. A key names one text.
    """
    held = texts.where(F.col(column).rlike(f"[{U.flagged_class(letters)}]"))
    found = hits(F.col(column), graphemes, letters)
    if heads is not None:
        with_head = lambda rows, values: F.transform(rows, lambda x: F.struct(x.alias("h"), F.get(values, x["line"] - 1).alias("head")))
        each = held.withColumn("hits_", found).select(F.col(key).alias("key_"), F.explode(let(with_head, F.col("hits_"), heads)).alias("y"))
        each = each.select("key_", F.col("y.h").alias("x"), F.col("y.head").alias("head"))
    else:
        each = held.select(F.col(key).alias("key_"), found.alias("hits_")).select("key_", F.explode("hits_").alias("x"))
    # The table has a row for each flagged character: some hundreds, fixed.
    rows = [(i, f"U+{ord(row[0]):04X}", *row) for i, row in enumerate(U.flagged_table())]
    named = ("codepoint", "ch", "category", "action", "safe_rule", "token", "name")
    table = texts.sparkSession.createDataFrame(rows, "kind int, " + ", ".join(f"{n} string" for n in named))
    named = each.select("*", "x.*").join(F.broadcast(table), "kind")
    place = lambda wanted, name: (F.col(name) if wanted else F.lit(None).cast("int")).alias(name)
    return named.select(
        F.col("key_").alias(key),
        "position",
        place(offsets, "byte_offset"),
        place(graphemes, "grapheme_index"),
        place(lines, "line"),
        place(lines, "column"),
        "ch",
        "codepoint",
        "name",
        "category",
        "action",
        "safe_rule",
        "token",
        said(F.col("verdict"), 0).alias("disposition"),
        said(F.col("verdict"), 1).alias("context"),
        *(["head"] if heads is not None else []),
    )


def findings(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences grouped by code point: counts by disposition, ordered positions, the gravest disposition."""
    count = lambda level: F.count_if(F.col("disposition") == level)
    grouped = found.groupBy(key, "codepoint", "category").agg(
        F.count("*").alias("n"),
        count("actionable").alias("actionable"),
        count("contextual").alias("contextual"),
        count("informational").alias("informational"),
        F.array_join(F.transform(F.sort_array(F.collect_list("position")), lambda p: p.cast("string")), ",").alias("positions"),
    )
    return judged(grouped)


def judged(grouped: DataFrame) -> DataFrame:
    """Counts by code point with the gravest disposition and the risk."""
    risk = mapped(U.RISK, F.col("category"))
    worst = F.when(F.col("actionable") > 0, "actionable").when(F.col("contextual") > 0, "contextual").otherwise("informational")
    return grouped.withColumn("disposition", worst).withColumn("risk", risk)


def text_findings(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``findings`` of the flagged characters of texts, which are counted in their row.

    What is shuffled is a row for each text and code point, its positions already a string, and not a
    row for each character. Texts of one key come together, as rows of ``occurrences`` do.
    """
    flagged = F.when(F.col(column).rlike(f"[{U.flagged_class()}]"), F.col(column))
    # Outer, as a plain one is filtered by size ahead, for which texts would go to Python twice; the join drops the nulls.
    each = texts.select(F.col(key).alias("key_"), places.counter()(flagged).alias("c_")).select("key_", F.explode_outer("c_").alias("c_"))
    rows = [(i, f"U+{ord(row[0]):04X}", row[1]) for i, row in enumerate(U.flagged_table())]
    table = texts.sparkSession.createDataFrame(rows, "kind int, codepoint string, category string")
    met = each.select("key_", "c_.*").join(F.broadcast(table), "kind").withColumnRenamed("key_", key)
    lists = met.groupBy(key, "codepoint", "category").agg(
        *[F.sum(c).alias(c) for c in places.COUNTS], F.collect_list("positions").alias("lists_")
    )
    several = F.flatten(F.transform("lists_", lambda p: F.split(p, ",").cast("array<int>")))
    positions = F.when(F.size("lists_") == 1, F.get("lists_", F.lit(0))).otherwise(F.array_join(F.sort_array(several).cast("array<string>"), ","))
    return judged(lists.withColumn("positions", positions).drop("lists_"))


def report(texts: DataFrame, found: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Totals of every document, also of those without a finding."""
    visible = F.col("category").isin("exotic_space", "homoglyph")
    count = lambda level: F.count_if(F.col("disposition") == level)
    totals = found.groupBy(key).agg(
        count("actionable").alias("actionable_count"),
        count("contextual").alias("contextual_count"),
        count("informational").alias("informational_count"),
        F.count_if(~visible & (F.col("disposition") != "informational")).alias("invisible_char_count"),
        F.count_if(~visible).alias("invisible_observation_count"),
        F.count_if(F.col("category") == "exotic_space").alias("exotic_space_count"),
        F.count_if(F.col("category") == "homoglyph").alias("homoglyph_count"),
    )
    sizes = texts.select(
        key,
        F.coalesce(F.length(column), F.lit(0)).alias("char_count"),
        F.coalesce(F.octet_length(column), F.lit(0)).alias("utf8_byte_count"),
        F.coalesce(F.regexp_count(column, F.lit(grapheme_pattern())), F.lit(0)).alias("grapheme_count"),
    )
    joined = sizes.join(totals, key, "left").na.fill(0, totals.columns[1:])
    return joined.withColumn("total_flags", F.col("actionable_count") + F.col("contextual_count")).withColumn(
        "observations_total", F.col("total_flags") + F.col("informational_count")
    )


def annotate(texts: DataFrame, found: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Texts with flagged characters replaced by bracketed markers."""
    marks = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("marks_"))

    def told(between: Column) -> Column:
        rest = F.transform("marks_", lambda m, i: F.concat(F.lit("⟨"), m["token"], F.lit("⟩"), F.get(between, i + 1)))
        return F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))

    whole = let(told, F.split(column, f"[{U.flagged_class()}]", -1))
    return texts.join(marks, key, "left").select(key, F.coalesce(whole, F.col(column)).alias("annotated_text"))
