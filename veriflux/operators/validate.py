"""Record validation as arrays of error messages, and the rubric evaluator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_schema import named, schema_errors
from ..functions.patterns import FORBIDDEN_MARKERS
from ..functions.text import contains_any, strip
from ..sources.schemas import TRACE_SCHEMA

# Enumerations and word lists of the checks.
CONFIDENCE = ["low", "medium", "high"]
RAW_POLICY = ["safe_to_store", "summarize_only", "do_not_reproduce"]
VAGUE_OWNERS = ["", "tbd", "unknown", "none", "n/a", "unassigned"]
ACTION_WORDS = ["send", "submit", "delete", "exfil", "access", "expose", "transfer", "execute", "deploy", "funds", "credential", "bypass", "inject", "redirect", "external", "move", "modify", "overwrite", "leak"]
MIN_OBSERVED, MIN_RECOMMENDED = 60, 50
# End of fixed values.
SIGNAL_FIELDS = ["signal_id", "title", "source_tier", "source_type", "source_name", "source_url", "observed_at", "summary", "risk_hypothesis", "affected_surfaces", "risk_categories", "evidence_status", "novelty", "actionability", "source_reliability", "raw_detail_policy", "proposed_probe"]


def errors(*checks: tuple[Column, str | Column]) -> Column:
    """Messages of the conditions that hold; a null condition counts as holding nothing."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for c, m in checks]))


def high(c: Column) -> Column:
    return F.coalesce(c.isin("high", "critical"), F.lit(False))


def as_document(*columns: Column | str) -> Column:
    """Typed columns as a VARIANT document; members that are null are absent."""
    return F.parse_json(F.to_json(F.struct(*columns)))


def trace_errors(document: Column, schema: dict = TRACE_SCHEMA) -> Column:
    """Errors of a decision trace, a VARIANT, by its JSON Schema; only without any, the cross-field ones."""
    get = lambda path, kind: F.try_variant_get(document, path, kind)
    h = high(get("$.severity", "string"))
    cross = errors(
        (h & ~F.coalesce(get("$.human_approval.required", "boolean"), F.lit(False)), "high/critical trace lacks human approval requirement"),
        (h & (get("$.human_approval.approval_gate", "string") == "none"), "high/critical trace lacks approval gate"),
        (h & (F.coalesce(get("$.owner", "string"), F.lit("")) == ""), "high/critical trace lacks owner"),
    )
    return named(schema_errors(document, schema), lambda e: F.when(F.size(e) > 0, F.transform(e, lambda m: F.concat(F.lit("schema: "), m))).otherwise(cross))


def trace_summary(traces: DataFrame) -> DataFrame:
    """Counts by severity and by category, the total, and high ones whose mitigation is not deployed."""
    g = traces.groupingSets([[F.col("severity")], [F.col("risk_category")], []], "severity", "risk_category").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(high(F.col("severity")) & (F.col("mitigation_status") != "deployed")).alias("high_not_deployed")
    )
    return g.select(F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "category").otherwise("total").alias("dimension"), F.coalesce("severity", "risk_category", F.lit("all")).alias("value"), "n", "high_not_deployed")


def signal_errors() -> Column:
    """All errors of a source signal."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(SIGNAL_FIELDS)]))
    outside = lambda c: c.isNull() | ~c.between(1, 5)
    probe = F.col("proposed_probe")
    return errors(
        (F.size(missing) > 0, F.concat(F.lit("missing required fields: "), F.array_join(missing, ", "))),
        (F.col("source_tier").isNull() | ~F.col("source_tier").isin(0, 1, 2, 3), "invalid source_tier"),
        *[(outside(F.col(f)), f"{f} must be integer 1-5") for f in ("novelty", "actionability", "source_reliability")],
        (F.col("raw_detail_policy").isNull() | ~F.col("raw_detail_policy").isin(RAW_POLICY), "invalid raw_detail_policy"),
        *[(probe[k].isNull(), f"proposed_probe missing {k}") for k in ("probe_id", "description", "expected_detection_stage", "safe_reproduction")],
        (F.size(F.coalesce("risk_categories", F.array())) == 0, "risk_categories cannot be empty"), (F.size(F.coalesce("affected_surfaces", F.array())) == 0, "affected_surfaces cannot be empty"),
    )


def hypothesis_errors() -> Column:
    outside = lambda c: c.isNull() | ~c.between(1, 5)
    return errors(
        *[(outside(F.col(f)), f"{f} must be integer 1-5") for f in ("likelihood", "impact", "novelty", "actionability")],
        (F.col("confidence").isNull() | ~F.col("confidence").isin(CONFIDENCE), "confidence must be low, medium, or high"),
        *[(F.size(F.coalesce(f, F.array())) == 0, f"{f} must be a non-empty list") for f in ("affected_surfaces", "early_indicators", "sources")],
        (F.exists(F.coalesce("sources", F.array()), lambda s: (F.coalesce(s["label"], F.lit("")) == "") | (F.coalesce(s["url"], F.lit("")) == "")), "each source must include label and url"),
    )


def split_valid(df: DataFrame, found: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with errors); strict makes evaluation fail at the first rejected row."""
    checked = df.withColumn("errors", found)
    valid = checked.where(F.size("errors") == 0).drop("errors")
    if strict:
        bad = F.raise_error(F.array_join("errors", "; "))
        valid = checked.where(F.when(F.size("errors") > 0, bad).otherwise(F.lit(True))).drop("errors")
    return valid, checked.where(F.size("errors") > 0)


def forbidden_markers(*texts: Column) -> Column:
    """Markers that a record's texts must not hold."""
    joined = F.lower(F.concat_ws("\n", *texts))
    return F.array_compact(F.array(*[F.when(F.contains(joined, F.lit(m)), F.lit(m)) for m in FORBIDDEN_MARKERS]))


def rubric_category(t: Column) -> Column:
    """good, or the first failure by priority, of a decision trace held in a struct column."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    h, ha, ev = high(t["severity"]), t["human_approval"], t["evidence"]
    observed, owner = empty(ev["observed_behavior"]), F.lower(strip(t["owner"]))
    missed = h & (~F.coalesce(ha["required"], F.lit(False)) | (F.coalesce(ha["approval_gate"], F.lit("none")) == "none"))
    unfounded = h & ~contains_any(F.lower(observed), ACTION_WORDS)
    routing = owner.isin(VAGUE_OWNERS) | F.coalesce((t["severity"] == "critical") & (t["mitigation_status"] == "none"), F.lit(False))
    weak = (F.length(observed) < MIN_OBSERVED) | (F.length(empty(t["recommended_action"])) < MIN_RECOMMENDED) | (F.size(F.coalesce(ev["open_questions"], F.array().cast("array<string>"))) == 0)
    return F.when(missed, "missed_escalation").when(unfounded, "false_positive").when(routing, "bad_routing").when(weak, "weak_summary").otherwise("good")


def rubric_label(category: Column) -> Column:
    return F.when(category == "good", "pass").otherwise("fail")
