"""Scanning files and texts: locations, fingerprints, baselines, suppressions, diffs, SARIF."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inspect

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def fingerprint(path: Column, category: Column, codepoint: Column, column: Column, line_head: Column) -> Column:
    """Identity of a finding that survives moved lines; ``line_head`` is the start of its line's hash."""
    return F.sha2(F.concat_ws("\u0000", path, category, codepoint, column.cast("string"), line_head).cast("binary"), 256)


def line_heads(text: Column) -> Column:
    """The first 16 hash digits of every line of a text."""
    return F.transform(F.split(text, LINE_ENDS), lambda row: F.substring(F.sha2(row.cast("binary"), 256), 1, 16))


def scan(files: DataFrame, dispositions: tuple[str, ...] = ("actionable",)) -> DataFrame:
    """Located findings of files(path, text): 1-based line and column; only a newline ends a line there."""
    found = inspect.occurrences(files, "path", "text", lines=True, heads=line_heads(F.col("text")))
    placed = found.where(F.col("disposition").isin(*dispositions)).drop("ch", "action", "safe_rule")
    empty = F.substring(F.sha2(F.lit("").cast("binary"), 256), 1, 16)
    mark = fingerprint(F.col("path"), F.col("category"), F.col("codepoint"), F.col("column"), F.coalesce("head", empty))
    risk = inspect.mapped(inspect.U.RISK, F.col("category"))
    return placed.withColumn("fingerprint", mark).withColumn("risk", risk).drop("head")


def with_baseline(findings: DataFrame, baseline: DataFrame, new_only: bool = False) -> DataFrame:
    """``state`` new or existing, by the fingerprints of an earlier scan."""
    known = baseline.select("fingerprint").distinct().withColumn("known_", F.lit(True))
    out = findings.join(known, "fingerprint", "left").withColumn("state", F.when(F.col("known_"), "existing").otherwise("new"))
    return (out.where("state = 'new'") if new_only else out).drop("known_")


def suppress(findings: DataFrame, patterns: list[str]) -> DataFrame:
    """Findings that match none of the patterns (exact or glob) on their keys.

    Each key is a filter of its own: files that go by their path are not looked into, and
    a fingerprint is made only for findings that no other key takes out.
    """
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    keys = (
        F.col("path"), F.col("category"), F.col("codepoint"), F.concat_ws(":", "path", "category"), F.concat_ws(":", "path", "codepoint"),
        place, F.col("fingerprint"),
    )
    for key in keys if patterns else ():
        findings = findings.where(~matches(key, patterns))
    return findings


#: Globs that are compared one by one; more are one pattern.
FEW = 16


def matches(value: Column, patterns: list[str]) -> Column:
    """Whether a value as a whole fits one of the globs: exact ones are looked up, a few of stars and marks are plain comparisons."""
    exact = [p for p in patterns if not set(p) & set("*?[")]
    open_ = [p for p in patterns if set(p) & set("*?[")]
    out = value.isin(exact) if exact else F.lit(False)
    if len(open_) > FEW or "[" in "".join(open_):
        return out | value.rlike("|".join(f"(?:{glob(p)})" for p in open_))
    for p in open_:
        held = p.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        out = out | value.like(held.replace("*", "%").replace("?", "_"))
    return out


def glob(pattern: str) -> str:
    """A glob as an anchored Java pattern; a star also crosses slashes."""
    return "^" + fnmatch.translate(pattern).replace("(?>", "(?:").replace(r"\Z", "$").replace(r"\z", "$")


def selected(path: Column, extensions: tuple[str, ...], exclude: list[str]) -> Column:
    """Whether a path has a wanted extension and matches no exclusion, by name or whole."""
    wanted = F.lower(path).rlike("(?:" + "|".join(e.lower().replace(".", r"\.") for e in extensions) + ")$")
    name = F.substring_index(path, "/", -1)
    out = wanted
    for p in exclude:
        out = out & ~name.rlike(glob(p)) & ~path.rlike(glob(p)) & ~path.rlike(glob(f"**/{p}"))
    return out


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select("path", "line").distinct(), ["path", "line"], "left_semi")


# The head of a hunk, with the first new line.
HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@"


def changed_lines(diffs: DataFrame) -> DataFrame:
    """Added lines of unified diffs(diff_id, text), of any number of files and hunks: diff_id, path, line.

    A line of a diff belongs to the nearest head above it: of a file (``+++``) or of a
    hunk. New lines are counted from a hunk's first one over added and kept lines. A line
    that is neither added, removed, kept nor a note ends its hunk; empty ones are passed
    over. Files that are gone (/dev/null) have no lines. Heads carry down by running
    windows within a diff, so a diff is sorted once.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("text", LINE_ENDS)).alias("i", "row"))
    row = F.col("row")
    file, hunk = row.startswith("+++ "), row.rlike(HUNK)
    name = F.substring_index(F.substring(row, 5, 1 << 20), "\t", 1)
    path = F.when(file, F.when(name.startswith("b/"), F.substring(name, 3, 1 << 20)).otherwise(name))
    above = Window.partitionBy("diff_id").orderBy("i")
    heads = rows.withColumns(
        {
            "path": F.last(path, ignorenulls=True).over(above),
            "head": F.last(F.when(file | hunk, F.struct("i", hunk.alias("hunk"), F.regexp_extract(row, HUNK, 1).try_cast("long").alias("first"))), ignorenulls=True).over(above),
        }
    )
    body = heads.where(F.col("head.hunk") & (F.col("i") > F.col("head.i")) & (F.col("path") != "/dev/null") & (row != ""))
    marker = F.substring(row, 1, 1)
    within = Window.partitionBy("diff_id", "head.i").orderBy("i")
    counted = body.withColumns(
        {
            "ended": F.count_if(~marker.isin("+", "-", " ", "\\")).over(within),
            "passed": F.count_if(marker.isin("+", " ")).over(within),
        }
    )
    added = counted.where((F.col("ended") == 0) & (marker == "+"))
    return added.select("diff_id", "path", (F.col("head.first") + F.col("passed") - 1).cast("int").alias("line"))


def sarif_level(disposition: Column, risk: Column) -> Column:
    return F.when((disposition == "actionable") & (risk == "high"), "error").when(disposition == "actionable", "warning").otherwise("note")


def sarif_result(path: Column, x: Callable[[str], Column]) -> Column:
    """A SARIF result as JSON, from the fields of a finding."""
    region = F.struct(x("line").alias("startLine"), x("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(
        F.struct(
            x("category").alias("ruleId"),
            sarif_level(x("disposition"), x("risk")).alias("level"),
            F.struct(F.concat_ws(" ", x("codepoint"), x("context")).alias("text")).alias("message"),
            F.array(place).alias("locations"),
            F.struct(x("fingerprint").alias("primary/v1")).alias("partialFingerprints"),
        )
    )


#: What a SARIF result needs of a finding.
SARIF_FIELDS = ("line", "column", "category", "disposition", "risk", "codepoint", "context", "fingerprint")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding, as JSON; level by disposition and risk."""
    level = sarif_level(F.col("disposition"), F.col("risk"))
    return findings.select("path", "line", level.alias("level"), sarif_result(F.col("path"), F.col).alias("result"))
