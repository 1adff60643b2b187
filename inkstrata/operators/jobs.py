"""A scan of files as one job: policy, findings, errors, fixes and SARIF logs."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places
from ..sources import files as sources
from . import sanitize, scan

MOST_POLICY_BYTES = 65_536
DISPOSITIONS = ("actionable", "contextual", "informational")


@dataclass(frozen=True)
class Policy:
    """What is scanned and what is told."""

    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = sources.EXTENSIONS
    max_file_bytes: int = 2_000_000
    dispositions: tuple[str, ...] = ("actionable",)
    suppressions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.max_file_bytes <= 1_000_000_000:
            raise ValueError("max_file_bytes must be between 1 and 1000000000")
        if not self.dispositions or not set(self.dispositions) <= set(DISPOSITIONS):
            raise ValueError("dispositions hold an unknown value")
        if not self.extensions:
            raise ValueError("extensions must not be empty")


def load_policy(path: str) -> Policy:
    """A policy from the ``scan`` table of a TOML file (``tool.inkstrata.scan`` in pyproject.toml); unknown keys are refused."""
    source = Path(path)
    if source.is_symlink() or not source.is_file() or source.stat().st_size > MOST_POLICY_BYTES:
        raise ValueError("a policy must be a regular file of bounded size")
    try:
        value = tomllib.loads(source.read_text(encoding="utf-8"))
    except (UnicodeError, tomllib.TOMLDecodeError) as error:
        raise ValueError("a policy must be TOML in UTF-8") from error
    if source.name == "pyproject.toml":
        value = value.get("tool", {}).get("inkstrata", {})
    value = value.get("scan", value)
    fields = Policy.__dataclass_fields__
    if not isinstance(value, dict) or not set(value) <= set(fields):
        raise ValueError("a policy holds unsupported keys")
    known: dict[str, object] = {}
    for name, given in value.items():
        if name == "max_file_bytes":
            if isinstance(given, bool) or not isinstance(given, int):
                raise ValueError("max_file_bytes must be a whole number")
            known[name] = given
        elif not isinstance(given, list) or not all(isinstance(x, str) and x.strip() for x in given):
            raise ValueError(f"{name} must be a list of texts")
        else:
            known[name] = tuple(x.strip() for x in given)
    if "extensions" in known:
        known["extensions"] = tuple("." + x.lower().lstrip(".") for x in known["extensions"])
    return Policy(**known)


def find_policy(start: str) -> str | None:
    """The nearest ``.inkstrata.toml`` or pyproject.toml with a scan table, from ``start`` upwards."""
    here = Path(start).resolve()
    for folder in (here, *here.parents) if here.is_dir() else here.parents:
        own, project = folder / ".inkstrata.toml", folder / "pyproject.toml"
        if own.is_file():
            return str(own)
        if project.is_file() and "[tool.inkstrata.scan]" in project.read_text(encoding="utf-8", errors="replace"):
            return str(project)
    return None


def resolve_policy(path: str | None = None, start: str = ".", discover: bool = True) -> Policy:
    """The named policy, else the nearest one, else the default."""
    found = path or (find_policy(start) if discover else None)
    return load_policy(found) if found else Policy()


def screen(
    texts: DataFrame,
    policy: Policy = Policy(),
    baseline: DataFrame | None = None,
    changed: DataFrame | None = None,
    new_only: bool = False,
) -> DataFrame:
    """Findings of texts(path, text) under a policy: on changed lines only, without suppressed ones, new or existing."""
    found = scan.scan(texts, policy.dispositions)
    if changed is not None:
        found = scan.on_changed_lines(found, changed)
    found = scan.suppress(found, list(policy.suppressions))
    if baseline is None:
        return found.withColumn("state", F.lit("new"))
    return scan.with_baseline(found, baseline, new_only)


@dataclass
class Report:
    """Findings, files that could not be read with the reason, and, if asked for, cleaned texts of files with findings."""

    findings: DataFrame
    errors: DataFrame
    fixes: DataFrame | None


def run(spark: SparkSession, root: str, policy: Policy = Policy(), fix: bool = False, profile: str = "safe", **options) -> Report:
    """Scan the files below ``root``. Fixes are given as rows (path, cleaned, edits), never written in place."""
    read = sources.text_files(spark, root, policy.extensions, policy.exclude, policy.max_file_bytes)
    texts = read.where("error is null").select("path", "text")
    findings = screen(texts, policy, **options)
    fixes = None
    if fix:
        done = sanitize.sanitize_with_edits(texts, profile, normalize=False, key="path")
        fixes = done.where(F.size("edits") > 0).select("path", "cleaned", "edits", "input_sha256", "output_sha256")
    return Report(findings, read.where("error is not null").select("path", "error"), fixes)


def located_edits(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """Edits of fixes with the line and column of each in its source: path, line, column, original, replacement, category."""
    policy = F.filter("edits", lambda e: e["stage"] == "policy")
    met = texts.select("path", "text").join(fixes.select("path", policy.alias("edits")), "path")
    where = places.lines(F.col("text"), F.transform("edits", lambda e: e["position"]))
    rows = met.withColumn("where_", where).select("path", F.explode(F.arrays_zip("edits", "where_")).alias("z"))
    edit = [F.col(f"z.edits.{c}").alias(c) for c in ("original", "replacement", "category")]
    return rows.select("path", F.col("z.where_.line").alias("line"), F.col("z.where_.column").alias("column"), *edit)


def write_fixes(fixes: DataFrame, folder: str) -> None:
    """Cleaned texts as rows of a table; the commit protocol of the writer makes it all or nothing."""
    fixes.select("path", "cleaned", "output_sha256").write.mode("errorifexists").parquet(folder)


def sarif_logs(findings: DataFrame, tool: str = "inkstrata", version: str = "1") -> DataFrame:
    """One SARIF 2.1.0 log a file, as JSON: path, log. Rules are the categories that occur in it.

    A log holds one file's findings, so no row outgrows its file.
    """
    every = findings.groupBy("path").agg(F.collect_list(F.struct(*scan.SARIF_FIELDS)).alias("found"), F.sort_array(F.collect_set("category")).alias("kinds"))
    told = lambda x: F.struct(x["line"].alias("line"), scan.sarif_result(F.col("path"), lambda c: x[c]).alias("result"))
    results = every.select("path", "kinds", F.sort_array(F.transform("found", told)).alias("results"))
    rule = lambda k: F.to_json(
        F.struct(
            k.alias("id"),
            F.struct(F.concat(F.lit("Suspicious Unicode: "), k).alias("text")).alias("shortDescription"),
            F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration"),
        )
    )
    rules = F.array_join(F.transform("kinds", rule), ",")
    listed = F.array_join(F.transform("results", lambda r: r["result"]), ",")
    log = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"'),
        F.lit(tool), F.lit('","semanticVersion":"'), F.lit(version), F.lit('","rules":['), rules, F.lit("]}},\"results\":["), listed, F.lit("]}]}"),
    )
    return results.select("path", log.alias("log"))
