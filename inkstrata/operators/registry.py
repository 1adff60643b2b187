"""Rules of sample registries and observation sets: every breach of every rule as a row.

A set of rules is one table of named conditions. Facts of a row are its own columns,
counts by id and by cluster, and the row it is paired with; they come from one
aggregate for each key and are joined back, so a cluster or id of any size is a few
numbers. All rules are then evaluated in one pass over the rows. Rows that are missing
have no row of their own and are found by comparing counts.

Defined results: a null in a field that a rule reads breaks the rule, except where the
field may be null (keys, errors, outcomes of rows that were not accepted). Repeated rows
break ``duplicate`` once each. Empty tables break no rule of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import protocol

# Forms of digests and public names, and states of an observation.
DIGEST, NAME = "^[0-9a-f]{64}$", "^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
STATES = ("accepted", "failed", "abstained")
#: Fields in which a null and the positive that it is paired with agree.
PAIRED = ("split", "cluster_id", "task", "language", "length_bin")
PAIRED_METADATA = ("generator_id", "decoding_config_sha256")


@dataclass(frozen=True)
class Registry:
    """What a study has registered: splits, the checkers of each task, languages, and the metadata of each cohort."""

    splits: tuple[str, ...]
    tasks: dict[str, tuple[str, ...]]
    languages: tuple[str, ...]
    cohorts: dict[str, tuple[str, ...]]
    positive: str = "watermarked_positive"
    null: str = "matched_generator_null"
    human: str = "human_control"


@dataclass(frozen=True)
class Run:
    """Detectors by role (one is primary) and conditions of a run."""

    detectors: dict[str, str]
    conditions: tuple[str, ...] = field(default=())

    @property
    def primary(self) -> str:
        found = [name for name, role in self.detectors.items() if role == "primary"]
        if len(found) != 1 or not set(self.detectors.values()) <= {"primary", "cross"}:
            raise ValueError("a run has one primary detector, and others are cross")
        return found[0]


def breaches(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule whose condition holds; a condition that is null counts as broken."""
    broken = F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()])
    return rows.select(*keys, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def keyed(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    """The sorted values that a key of a small fixed table has; null for others."""
    out = F.lit(None).cast("array<string>")
    for name, values in table.items():
        out = F.when(key == name, F.array(*map(F.lit, sorted(values))).cast("array<string>")).otherwise(out)
    return out


def sample_breaches(samples: DataFrame, split_keys: DataFrame, registry: Registry) -> DataFrame:
    """(sample_id, rule) of samples(sample_id, cluster_id, split, task, language, cohort, input_sha256,
    effective_detector_tokens, length_bin, key_fingerprint, task_checkers, metadata), with split_keys(key_fingerprint, split)."""
    about = F.struct(F.lit(True).alias("known"), "cohort", *PAIRED, *[F.col("metadata")[m].alias(m) for m in PAIRED_METADATA])
    by_id = samples.groupBy("sample_id").agg(F.count("*").alias("copies_"), F.first(about).alias("about_"))
    by_cluster = samples.groupBy("cluster_id").agg(F.min("split").alias("split_a_"), F.max("split").alias("split_z_"))
    keys = split_keys.groupBy("key_fingerprint").agg(F.min("split").alias("key_split_"), F.max("split").alias("key_other_"))
    paired = by_id.select(F.col("sample_id").alias("pair_"), F.col("about_").alias("partner_"))
    rows = samples.withColumn("pair_", F.col("metadata")["paired_sample_id"])
    rows = rows.join(by_id.select("sample_id", "copies_"), "sample_id", "left").join(by_cluster, "cluster_id", "left")
    rows = rows.join(keys, "key_fingerprint", "left").join(paired, "pair_", "left")
    meta, cohort, key = F.col("metadata"), F.col("cohort"), F.col("key_fingerprint")
    known = lambda values, c: F.coalesce(c.isin(*values), F.lit(False))
    human, null = cohort == registry.human, cohort == registry.null
    registered = F.col("key_split_").isNotNull()
    partner_fits = F.coalesce(F.col("partner_.known") & (F.col("partner_.cohort") == registry.positive), F.lit(False))
    differs = F.lit(False)
    for c in PAIRED:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"partner_.{c}"))
    for m in PAIRED_METADATA:
        differs = differs | ~meta[m].eqNullSafe(F.col(f"partner_.{m}"))
    of_kind = lambda kind, test: F.coalesce(kind, F.lit(False)) & F.coalesce(test, F.lit(True))
    return breaches(
        rows,
        ["sample_id"],
        {
            "malformed id": ~F.col("sample_id").rlike(NAME) | ~F.col("cluster_id").rlike(NAME),
            "duplicate": F.col("copies_") > 1,
            "unknown split": ~known(registry.splits, F.col("split")),
            "unknown task": ~known(registry.tasks, F.col("task")),
            "unknown language": ~known(registry.languages, F.col("language")),
            "unknown cohort": ~known(registry.cohorts, cohort),
            "metadata fields are not the cohort's": known(registry.cohorts, cohort)
            & F.coalesce(F.array_sort(F.map_keys(meta)) != keyed(registry.cohorts, cohort), F.lit(True)),
            "malformed digest": ~F.col("input_sha256").rlike(DIGEST),
            "wrong length bin": F.col("length_bin") != protocol.length_bin(F.col("effective_detector_tokens")),
            "unregistered key": key.isNotNull() & ~registered,
            "key of another split": F.coalesce(registered & (F.col("key_split_") != F.col("split")), F.lit(False)),
            "key of two splits": F.coalesce(F.col("key_split_") != F.col("key_other_"), F.lit(False)),
            "human control with a key": F.coalesce(human, F.lit(False)) & key.isNotNull(),
            "human control was exposed": of_kind(human, (meta["generator_exposed"] != "false") | (meta["rewriter_exposed"] != "false")),
            "human control without a date": of_kind(human, ~meta["source_date"].rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")),
            "task checkers are missing": known(registry.tasks, F.col("task"))
            & F.coalesce(F.size(F.array_except(keyed(registry.tasks, F.col("task")), F.col("task_checkers"))) > 0, F.lit(True)),
            "cluster crosses splits": F.coalesce(F.col("split_a_") != F.col("split_z_"), F.lit(False)),
            "null without its positive": F.coalesce(null, F.lit(False)) & ~partner_fits,
            "null differs from its positive": F.coalesce(null, F.lit(False)) & partner_fits & differs,
        },
    )


def observation_breaches(observations: DataFrame, samples: DataFrame, run: Run) -> DataFrame:
    """(sample_id, detector_id, condition_id, rule); ids of detector and condition are null where rows of a sample are missing.

    observations as evaluation.aggregate_observations takes them, telemetry with
    remote_queries, generated_tokens and estimated_cost_usd among its fields.
    """
    keys = ["sample_id", "detector_id", "condition_id"]
    facts = samples.groupBy("sample_id").agg(F.max("effective_detector_tokens").alias("tokens_"), F.lit(True).alias("known_"))
    copies = observations.groupBy(*keys).agg(F.count("*").alias("copies_"))
    rows = observations.join(facts, "sample_id", "left").join(copies, keys, "left")
    state, error, history = F.col("transformation_state"), F.col("error_class"), F.col("attempt_history")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    outcomes = ("quality_gate_passed", "task_check_passed")
    costs = ("remote_queries", "generated_tokens", "estimated_cost_usd")
    whole = lambda t: F.forall(F.array(*[t[c].isNotNull() for c in costs]), lambda x: x)
    last = F.element_at(history, -1)
    tried = F.coalesce(F.size(history) > 0, F.lit(False))
    any_try = lambda test: tried & F.coalesce(F.exists(history, test), F.lit(True))
    places = F.transform(history, lambda h, i: h["attempt_index"] != i + 1)
    ends_otherwise = (
        ~last["state"].eqNullSafe(state) | ~last["error_class"].eqNullSafe(error)
        | ~F.to_json(last["telemetry"]).eqNullSafe(F.to_json("telemetry")) | ~last["telemetry_complete"].eqNullSafe(whole(last["telemetry"]))
    )
    bad_name = lambda c: c.isNotNull() & ~c.rlike(NAME)
    found = breaches(
        rows,
        keys,
        {
            "unknown sample": F.col("known_").isNull(),
            "unknown detector": ~F.col("detector_id").isin(*run.detectors),
            "unknown condition": ~F.col("condition_id").isin(*run.conditions),
            "duplicate": F.col("copies_") > 1,
            "score is not finite": ~(finite("source_score") & finite("candidate_score")),
            "tokens are negative": (F.col("source_effective_tokens") < 0) | (F.col("candidate_effective_tokens") < 0),
            "tokens differ from registration": F.coalesce(F.col("detector_id") == run.primary, F.lit(False))
            & F.col("known_").isNotNull() & ~F.col("source_effective_tokens").eqNullSafe(F.col("tokens_")),
            "unknown state": ~state.isin(*STATES),
            "accepted without outcomes": F.coalesce(state == "accepted", F.lit(False)) & (F.col(outcomes[0]).isNull() | F.col(outcomes[1]).isNull()),
            "outcomes without acceptance": F.coalesce(state != "accepted", F.lit(True)) & (F.col(outcomes[0]).isNotNull() | F.col(outcomes[1]).isNotNull()),
            "malformed error": bad_name(error),
            "failed without an error": F.coalesce(state == "failed", F.lit(False)) & error.isNull(),
            "empty history": history.isNotNull() & (F.size(history) == 0),
            "attempts are not in order": tried & F.coalesce(F.exists(places, lambda x: x), F.lit(True)),
            "unknown state of an attempt": any_try(lambda h: ~h["state"].isin(*STATES)),
            "malformed error of an attempt": any_try(lambda h: bad_name(h["error_class"])),
            "failed attempt without an error": any_try(lambda h: (h["state"] == "failed") & h["error_class"].isNull()),
            "complete telemetry with gaps": any_try(lambda h: h["telemetry_complete"] & ~whole(h["telemetry"])),
            "history ends otherwise": tried & F.coalesce(ends_otherwise, F.lit(True)),
        },
    )
    wanted = len(run.detectors) * len(run.conditions)
    inside = F.col("detector_id").isin(*run.detectors) & F.col("condition_id").isin(*run.conditions)
    held = copies.where(inside).groupBy("sample_id").agg(F.count("*").alias("held_"))
    few = samples.select("sample_id").distinct().join(held, "sample_id", "left").where(F.coalesce("held_", F.lit(0)) < wanted)
    none = F.lit(None).cast("string")
    return found.unionByName(few.select("sample_id", none.alias("detector_id"), none.alias("condition_id"), F.lit("observations are missing").alias("rule")))
