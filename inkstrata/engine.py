"""One object for the public calls: options, plans with a digest, consent, and the operators behind them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import bundles, records, session
from .operators import detect as detectors
from .operators import inspect as inspection
from .operators import localize as localization
from .operators import sanitize as cleaning

MODES = ("sanitize", "inspect", "rewrite")


@dataclass(frozen=True)
class Options:
    """What a session may use. Nothing outside the cluster is used unless it is allowed by name."""

    profile: str = "safe"
    normalize: bool = True
    allow_network: bool = False
    allow_model_download: bool = False
    extensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.profile not in ("safe", "aggressive"):
            raise ValueError("profile must be safe or aggressive")

    def local_only(self) -> Options:
        """The same options without network, downloads and extensions."""
        return replace(self, allow_network=False, allow_model_download=False, extensions=())


def requirements(mode: str, options: Options) -> dict[str, object]:
    """What a mode needs, and whether the options allow it."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    needs = ["rewriter"] if mode == "rewrite" else []
    missing = [n for n in needs if n not in options.extensions]
    return {"mode": mode, "passes_over_text": 2 if mode == "sanitize" else 1, "needs": needs, "missing": missing, "ready": not missing}


def create_plan(mode: str, options: Options = Options()) -> dict[str, object]:
    """What would be done, without doing it, and the digest that consents to it."""
    plan = {"requirements": requirements(mode, options), "options": asdict(options)}
    return plan | {"digest": bundles.digest(plan)}


def apply_plan(texts: DataFrame, plan_digest: str, mode: str, options: Options = Options(), consent: bool = False) -> DataFrame:
    """Apply a plan that was looked at: its digest must be that of the same mode and options, with consent."""
    plan = create_plan(mode, options)
    if not consent:
        raise PermissionError("applying a plan needs consent")
    if plan["digest"] != plan_digest:
        raise ValueError("the plan is not the one that was looked at")
    if not plan["requirements"]["ready"]:
        raise ValueError("the plan needs what the options do not allow: " + ", ".join(plan["requirements"]["missing"]))
    return Engine(options).run(texts, mode)


def require_extension(name: str, kind: str, options: Options, consent: bool = False) -> records.Detector:
    """A registered extension, if the options name it and consent is given."""
    facts = records.facts(name)
    if facts.get("kind", "detector") != kind:
        raise ValueError(f"{name} is not a {kind}")
    if name not in options.extensions or not consent:
        raise PermissionError(f"{name} is not allowed")
    return records.resolve(name)


#: Facts of a detector that may be shown.
PUBLIC_FACTS = ("scheme", "calibrated", "independent", "kind", "version")


def public_capability(name: str) -> dict[str, str]:
    return {"detector": name} | {k: v for k, v in records.facts(name).items() if k in PUBLIC_FACTS}


def schemas() -> dict[str, T.StructType]:
    """The row types of inputs and results by name."""
    ddl = {
        "texts": "doc_id long, text string",
        "occurrence": "doc_id long, position int, byte_offset int, grapheme_index int, line int, column int, ch string, codepoint string, "
        "name string, category string, action string, safe_rule string, token string, disposition string, context string",
        "edit": "stage string, position int, output_position int, original string, replacement string, category string",
        "sanitized": "doc_id long, cleaned string, counts map<string,int>, edits " + cleaning.EDITS + ", input_sha256 string, output_sha256 string",
        "evidence": "doc_id long, detector string, scheme string, status string, score double, threshold double, operator string, "
        "direction string, configuration_sha256 string",
        "verification": "doc_id long, verification string, reason string",
        "span": "doc_id long, start int, end int, contributing_windows long, strongest_margin double, smallest_p_value double",
        "localization": "doc_id long, status string, method string, windows_scored long, n_spans long, reason string",
        "finding": "path string, line int, column int, category string, codepoint string, risk string, disposition string, fingerprint string",
    }
    return {name: T._parse_datatype_string(text) for name, text in ddl.items()}


class Engine:
    """The operators under one set of options."""

    def __init__(self, options: Options = Options()):
        self.options = options

    def run(self, texts: DataFrame, mode: str) -> DataFrame:
        if mode == "inspect":
            return self.inspect(texts)
        if mode == "sanitize":
            return self.sanitize(texts)
        raise ValueError("rewriting needs an extension")

    def inspect(self, texts: DataFrame) -> DataFrame:
        """Totals of each document, bound to its content: the report with ``text_sha256``."""
        told = inspection.report(texts, inspection.occurrences(texts, offsets=False))
        return told.join(texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")), "doc_id")

    def sanitize(self, texts: DataFrame) -> DataFrame:
        return cleaning.sanitize_with_edits(texts, self.options.profile, self.options.normalize)

    def detect(self, texts: DataFrame, key: str = detectors.KEY) -> DataFrame:
        return session.normalized(session.observe(texts, key=key))

    def verify(self, source: DataFrame, candidate: DataFrame, registry: DataFrame, key: str = detectors.KEY) -> DataFrame:
        return session.verify(self.detect(source, key), self.detect(candidate, key), registry)

    def localize(self, texts: DataFrame, detector, calibrated: bool = False) -> tuple[DataFrame, DataFrame]:
        return localization.localize(texts, detector, calibrated)

    def capabilities(self) -> list[dict[str, str]]:
        return [public_capability(name) for name in records.names()]
