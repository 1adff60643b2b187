"""Evidence bundles, checkpoint journals, budgets and registries: what a study leaves behind, bound by digests.

Tables stay tables: a bundle is a small JSON document that names them by content
digest, made by aggregates. Nothing here reads a text back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import protocol, records

PURPOSES = ("harness_conformance", "exploratory", "frozen_evaluation")
SHA256 = re.compile(r"[0-9a-f]{64}")
NAME = re.compile(r"[a-z0-9][a-z0-9._-]{0,63}")
#: Keys that a bundle must not hold, as they would carry content or access.
FORBIDDEN = ("text", "prompt", "candidate", "source_text", "password", "secret", "token", "api_key", "authorization")
MOST_BYTES = 4 << 20


def canonical(value: object) -> str:
    """Sorted compact JSON; non-finite numbers are null."""
    return json.dumps(records.finite(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def forbidden_keys(value: object) -> list[str]:
    """Keys at any depth that must not be published."""
    if isinstance(value, Mapping):
        return [k for k in value if str(k).lower() in FORBIDDEN] + [x for v in value.values() for x in forbidden_keys(v)]
    return [x for v in value for x in forbidden_keys(v)] if isinstance(value, (list, tuple)) else []


def table_artifact(name: str, df: DataFrame) -> dict[str, object]:
    """A table's entry: its name, schema, number of rows and content digest, by one aggregate."""
    whole = protocol.score_table_digest(df.withColumn("all_", F.lit(1)), ["all_"], df.columns).first()
    n, content = (whole["n"], whole["digest"]) if whole else (0, hashlib.sha256(b"").hexdigest())
    return {"name": name, "schema": df.schema.simpleString(), "rows": n, "sha256": content}


def create(
    purpose: str,
    manifest: Mapping[str, object],
    results: Mapping[str, object],
    tables: Mapping[str, DataFrame],
    coverage: Mapping[str, str],
    reproduction: Mapping[str, object],
    telemetry: Mapping[str, object] | None = None,
) -> dict[str, object]:
    """A bundle that names its tables by digest and itself by the digest of all the rest."""
    body: dict[str, object] = {
        "version": "1",
        "purpose": purpose,
        "manifest": dict(manifest),
        "results": dict(results),
        "artifacts": [table_artifact(name, df) for name, df in sorted(tables.items())],
        "coverage": dict(coverage),
        "reproduction": dict(reproduction),
        "telemetry": dict(telemetry or {}),
    }
    bundle = json.loads(canonical(body))
    bundle["bundle_id"] = digest(bundle)
    problems = validate(bundle)
    if problems:
        raise ValueError("; ".join(problems))
    return bundle


def validate(bundle: Mapping[str, object], tables: Mapping[str, DataFrame] | None = None, areas: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a bundle; with ``tables`` their digests are made anew and compared."""
    wanted = {"version", "purpose", "manifest", "results", "artifacts", "coverage", "reproduction", "telemetry", "bundle_id"}
    if not isinstance(bundle, Mapping) or set(bundle) != wanted:
        return ["fields do not match"]
    found = []
    if bundle["purpose"] not in PURPOSES:
        found.append("unknown purpose")
    if bundle["bundle_id"] != digest({k: v for k, v in bundle.items() if k != "bundle_id"}):
        found.append("content digest does not match")
    found += [f"key {k} must not be published" for k in forbidden_keys(bundle)]
    names = [a.get("name") for a in bundle["artifacts"]]
    if len(names) != len(set(names)):
        found.append("an artifact is named twice")
    found += [f"artifact {a.get('name')} has no digest" for a in bundle["artifacts"] if not SHA256.fullmatch(str(a.get("sha256")))]
    found += [f"coverage lacks {a}" for a in areas if a not in bundle["coverage"]]
    for name, df in (tables or {}).items():
        held = next((a for a in bundle["artifacts"] if a["name"] == name), None)
        if held is None or held != table_artifact(name, df):
            found.append(f"artifact {name} is not the table that was bundled")
    return found


def write(path: str, bundle: Mapping[str, object], replace: bool = False) -> None:
    """Write a bundle at once or not at all, readable by its owner only."""
    if os.path.exists(path) and not replace:
        raise FileExistsError(path)
    handle, partial = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(canonical(bundle))
        os.replace(partial, path)
    except BaseException:
        os.unlink(partial)
        raise


def read(path: str) -> dict[str, object]:
    """A bundle of bounded size, strictly read and validated."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError("the bundle is too large")
    with open(path, encoding="utf-8") as source:
        bundle = records.strict(source.read())
    problems = validate(bundle)
    if problems:
        raise ValueError("; ".join(problems))
    return bundle


def replay(bundle: Mapping[str, object], steps: Mapping[str, object], execute: bool = False) -> list[dict[str, object]]:
    """The bundle's reproduction steps in order, and, if they are to run, whether each gave its table again.

    ``steps`` holds a function for each step's name that returns the step's table.
    """
    out = []
    for step in bundle["reproduction"].get("steps", []):
        name, known = step["name"], step["name"] in steps
        row = {"step": name, "artifact": step.get("artifact"), "state": "planned" if known else "unknown"}
        if execute and known:
            made = table_artifact(step["artifact"], steps[name]())
            row["state"] = "reproduced" if made in bundle["artifacts"] else "differs"
        out.append(row)
    return out


def replication_problems(record: Mapping[str, object], source: Mapping[str, object], reproduced: Mapping[str, object]) -> list[str]:
    """What keeps a record from binding two bundles: their ids, independence, and tables that differ."""
    found = validate(source) + validate(reproduced)
    if record.get("source_bundle_id") != source.get("bundle_id") or record.get("reproduced_bundle_id") != reproduced.get("bundle_id"):
        found.append("the record names other bundles")
    if source.get("bundle_id") == reproduced.get("bundle_id"):
        found.append("a bundle does not replicate itself")
    if record.get("independent") is not True:
        found.append("the replication is not independent")
    tables = lambda b: {a["name"]: (a["schema"], a["rows"]) for a in b.get("artifacts", [])}
    if tables(source) != tables(reproduced):
        found.append("the tables are of other shapes")
    return found


def telemetry(started: float, finished: float | None = None, **counters: float | None) -> dict[str, float | None]:
    """Wall time and counters of a run; counters that are not known are null, never zero."""
    known = ("peak_rss_bytes", "remote_queries", "generated_tokens", "estimated_cost_usd")
    if not set(counters) <= set(known):
        raise ValueError("unknown counter")
    return {"wall_time_seconds": (finished or time.time()) - started} | {k: counters.get(k) for k in known}


class Journal:
    """An append-only table of events of runs: a rerun skips what is done."""

    SCHEMA = "run_id string, unit string, state string, payload string, at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def append(self, run_id: str, rows: DataFrame) -> None:
        """Record rows(unit, state, payload); the writer's commit makes each call all or nothing."""
        events = rows.select(F.lit(run_id).alias("run_id"), "unit", "state", "payload", F.current_timestamp().alias("at"))
        events.write.mode("append").partitionBy("run_id").parquet(self.folder)

    def events(self, run_id: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder).where(F.col("run_id") == run_id)
        except Exception as error:  # nothing is recorded yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def pending(self, run_id: str, planned: DataFrame) -> DataFrame:
        """Units of ``planned`` that are not done, whatever else was recorded of them."""
        return planned.join(self.events(run_id).where("state = 'done'").select("unit").distinct(), "unit", "left_anti")


@dataclass
class Budget:
    """What a run may spend; ``spend`` refuses before a limit is passed, and never in part."""

    records: int
    tokens: int
    seconds: float
    spent: dict[str, int] = field(default_factory=lambda: {"records": 0, "tokens": 0})
    started: float = field(default_factory=time.monotonic)

    def spend(self, records: int = 0, tokens: int = 0) -> bool:
        if min(records, tokens) < 0:
            raise ValueError("nothing is given back")
        late = time.monotonic() - self.started > self.seconds
        if late or self.spent["records"] + records > self.records or self.spent["tokens"] + tokens > self.tokens:
            return False
        self.spent["records"] += records
        self.spent["tokens"] += tokens
        return True


def protocol_problems(registry: Mapping[str, object]) -> list[str]:
    """What is wrong with a protocol registry: names, contiguous length bins from zero, areas."""
    found = []
    for name in ("splits", "tasks", "languages", "cohorts", "coverage_areas"):
        values = registry.get(name)
        if not isinstance(values, list) or not values or len(set(map(str, values))) != len(values):
            found.append(f"{name} must be a list of different values")
        elif not all(isinstance(v, str) and NAME.fullmatch(v) for v in values):
            found.append(f"{name} holds a value that is no name")
    bins, begin = registry.get("length_bins"), 0
    if not isinstance(bins, list) or not bins:
        return [*found, "length_bins must be a list"]
    for i, item in enumerate(bins):
        low, high = item.get("minimum_inclusive"), item.get("maximum_exclusive")
        if low != begin:
            found.append("length bins must follow each other from zero")
            break
        if high is None and i < len(bins) - 1:
            found.append("only the last length bin may be open")
            break
        if high is not None and high <= low:
            found.append("a length bin is empty")
            break
        begin = high
    return found


def comparator_problems(registry: Mapping[str, object]) -> list[str]:
    """What is wrong with a comparator registry: it must be frozen, with one identity control and different conditions."""
    found = []
    if registry.get("frozen") is not True:
        found.append("the registry must be frozen")
    analysis = registry.get("analysis") or {}
    if analysis.get("method") != "holm_bonferroni_cluster_paired_sign_test" or analysis.get("family") != "detector_and_fixed_fpr":
        found.append("the analysis is not the registered one")
    alpha = analysis.get("alpha")
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)) or not 0 < alpha < 1:
        found.append("alpha must lie between 0 and 1")
    conditions = registry.get("conditions") or []
    ids = [c.get("id") for c in conditions]
    if len(conditions) < 2 or len(set(ids)) != len(ids) or not all(isinstance(i, str) and NAME.fullmatch(i) for i in ids):
        found.append("two or more conditions with names of their own are needed")
    if any(c.get("role") not in ("negative_control", "system_under_test", "baseline") for c in conditions):
        found.append("a condition has an unknown role")
    control = [c for c in conditions if c.get("role") == "negative_control"]
    if len(control) != 1 or control[0].get("adapter_required") is not False or control[0].get("id") != registry.get("control_condition_id"):
        found.append("one negative control without an adapter must be named")
    elif control[0].get("implementation_binding") != "intrinsic_identity_transform":
        found.append("the control must be the identity")
    return found


def results_markdown(tables: Mapping[str, DataFrame], most_rows: int = 200) -> str:
    """A report of small result tables; a table with more rows than ``most_rows`` is cut and says so."""
    parts = []
    for name, df in tables.items():
        rows = df.orderBy(*df.columns[:1]).limit(most_rows + 1).collect()
        head = [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most_rows]]
        parts += [*head, *body, "", *(["(more rows are left out)", ""] if len(rows) > most_rows else [])]
    return "\n".join(parts)
