"""Signature monitor: rules as data, compiled to Column expressions; privacy-safe aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PROMPT_INJECTION, SECRET
from ..functions.text import contains_any, excerpt, first_match, text_hash


@dataclass(frozen=True)
class Rule:
    signature_id: str
    name: str
    target: str
    category: str
    severity: str
    recommended_action: str = ""
    patterns: tuple[str, ...] = ()
    requires_external_side_effect: bool = False
    requires_missing_approval: bool = False
    sensitive_terms: tuple[str, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)


# The signature pack.
RULES = [
    Rule("ARA-PI-001", "Instruction override language", "input_or_output", "prompt_injection", "high", "Quarantine instruction-like text, preserve source provenance, and require safe reformulation.", tuple(PROMPT_INJECTION[:5])),
    Rule("ARA-DL-001", "Secret-like value in output", "output", "data_leakage", "high", "Redact output, inspect provenance, and rotate any real credential.", tuple(SECRET)),
    Rule(
        "ARA-SE-001", "Social engineering pressure pattern", "input_or_output", "social_engineering", "medium", "Route to user-protection review and remove deception or urgency scaffolding.",
        (r"urgent.{0,40}(password|credential|payment|wire|verification)", r"do not tell (security|legal|your manager|the user)", r"pretend to be (support|it|a bank|a recruiter)"),
    ),
    Rule("ARA-TC-001", "Tool call without required approval", "tool_call", "missing_approval", "high", "Block tool call until specific pre-action approval is received.", requires_external_side_effect=True, requires_missing_approval=True),
    Rule("ARA-CB-001", "Cross-connector sensitive action", "tool_call", "connector_data_boundary", "high", "Require source, destination, data class, reversibility, and owner before execution.", sensitive_terms=("credential", "secret", "token", "contact list", "compensation")),
    Rule("ARA-TM-001", "Unstable consequential tool selection", "telemetry", "unstable_action_selection", "medium", "Route to slower review before consequential tool use.", thresholds={"tool_choice_entropy_min": 2.0, "top_choice_margin_max": 0.1, "sample_disagreement_min": 0.5}),
]
# End of fixed values.

def rules_of(pack: DataFrame) -> list[Rule]:
    """Rules from a pack read with sources.readers.rule_pack; a pack is a small configuration table, in its order."""
    rules = []
    for r in pack.collect():
        given = {k: v for k, v in r.asDict(recursive=True).items() if v is not None and k in Rule.__dataclass_fields__}
        for k in ("patterns", "sensitive_terms"):
            given[k] = tuple(given.get(k, ()))
        given["thresholds"] = {k: v for k, v in given.get("thresholds", {}).items() if v is not None}
        rules.append(Rule(**given))
    return rules


HIT = "array<struct<stage:string,match:string,evidence:string>>"


def _hits(items: Column) -> Column:
    return F.coalesce(F.filter(items, lambda x: x["match"].isNotNull()), F.array().cast(HIT))


def _hit(stage: Column, match: Column, evidence: Column) -> Column:
    return F.struct(stage.alias("stage"), match.alias("match"), F.coalesce(evidence, F.lit("")).alias("evidence"))


def call_evidence(call: Column) -> Column:
    """Canonical text of a tool call: fields by name, absent ones empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("approval="), text(call["approval"]["received"]), F.lit(";args="), text(call["args"]), F.lit(";connector="), text(call["connector"]), F.lit(";external_side_effect="), text(call["external_side_effect"]), F.lit(";tool="), text(call["tool"]))


def rule_hits(rule: Rule) -> Column:
    """What one rule finds in a session, at most one hit for each of its targets."""
    if rule.target in ("input", "output", "input_or_output"):
        parts = []
        of = lambda stage, text: _hit(stage, first_match(F.coalesce(text, F.lit("")), list(rule.patterns)), text)
        if rule.target != "output":
            parts.append(F.array(of(F.lit("input"), F.col("user_prompt"))))
            item = lambda x: of(F.concat(F.lit("retrieved:"), F.coalesce(x["source"], F.lit("unknown"))), x["content"])
            parts.append(F.coalesce(F.transform("retrieved_context", item), F.array().cast(HIT)))
        if rule.target != "input":
            parts.append(F.array(of(F.lit("output"), F.col("model_output"))))
        return _hits(F.concat(*parts))
    if rule.target == "tool_call":

        def of_call(x: Column) -> Column:
            cond = F.lit(True)
            if rule.requires_external_side_effect:
                cond = cond & F.coalesce(x["external_side_effect"], F.lit(False))
            if rule.requires_missing_approval:
                cond = cond & ~F.coalesce(x["approval"]["received"], F.lit(False))
            if rule.sensitive_terms:
                cond = cond & contains_any(F.lower(F.coalesce(x["args"], F.lit(""))), list(rule.sensitive_terms))
            return _hit(F.lit("tool_call"), F.when(cond, F.lit("tool-condition")), call_evidence(x))

        return _hits(F.transform("tool_calls", of_call))
    t, at = F.col("telemetry"), rule.thresholds
    margin = F.coalesce(F.nullif(t["top_choice_margin"], F.lit(0.0)), F.lit(1.0))
    fires = (
        (F.coalesce(t["tool_choice_entropy"], F.lit(0.0)) >= at.get("tool_choice_entropy_min", 999.0))
        & (margin <= at.get("top_choice_margin_max", -1.0))
        & (F.coalesce(t["sample_disagreement"], F.lit(0.0)) >= at.get("sample_disagreement_min", 999.0))
    )
    text = F.concat_ws(",", *[F.coalesce(t[k].cast("string"), F.lit("")) for k in ("sample_disagreement", "tool_choice_entropy", "top_choice_margin")])
    return _hits(F.array(_hit(F.lit("telemetry"), F.when(fires, F.lit("telemetry-threshold")), text)))


def monitor_events(sessions: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Fingerprinted events in rule order. Rules are few and become expressions, so nothing is joined."""
    def events_of(rule: Rule) -> Column:
        named = {"signature_id": rule.signature_id, "signature_name": rule.name, "recommended_action": rule.recommended_action, "category": rule.category, "severity": rule.severity}
        return F.transform(rule_hits(rule), lambda h: F.struct(*[F.lit(v).alias(k) for k, v in named.items()], *[h[k].alias(k) for k in ("stage", "match", "evidence")]))

    found = F.concat(*map(events_of, rules))
    rows = sessions.select("session_id", F.coalesce("model", F.lit("unknown")).alias("model"), F.posexplode(found).alias("event_ord", "e"))
    return rows.select("session_id", "model", "event_ord", "e.*").select(
        "session_id", "model", "event_ord", "signature_id", "signature_name", "category", "severity", "stage", "match",
        excerpt(F.col("evidence")).alias("evidence_excerpt"), text_hash(F.col("evidence")).alias("evidence_hash"), "recommended_action",
    )


def monitor_summary(events: DataFrame) -> DataFrame:
    """Counts by category, severity and signature, and the total, in one pass."""
    sets = events.groupingSets([[F.col("category")], [F.col("severity")], [F.col("signature_id")], []], "category", "severity", "signature_id")
    return sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n")).select(
        F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").when(F.col("g") == 6, "signature").otherwise("total").alias("dimension"),
        F.coalesce("category", "severity", "signature_id", F.lit("all")).alias("value"), "n",
    )


def privacy_aggregate(events: DataFrame) -> DataFrame:
    """One row without raw text: counts and the distinct signatures, categories and severities."""
    names = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  bounded by the rule pack
    return events.agg(
        F.lit("aggregate_only_no_raw_prompt_output_or_tool_args").alias("privacy_policy"), F.count("*").alias("source_event_count"),
        F.count_distinct("session_id").alias("affected_session_count"), names("signature_id").alias("signature_ids"),
        names("category").alias("categories"), names("severity").alias("severities"),
    )


def fingerprints(events: DataFrame) -> DataFrame:
    """Fingerprints of events, one row each rather than one unbounded array."""
    return events.select("signature_id", "category", "severity", "stage", "evidence_hash")
