"""Triage of aggregate telemetry shared by sentinel nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that must not occur in shared data.
RAW_FIELD_NAMES = ["raw_prompt", "raw_output", "raw_tool_args", "raw_document", "raw_file", "evidence_text", "private_text"]
# End of fixed values.


def event_score(e: Column) -> Column:
    """0 to 15. Unlike elsewhere, a margin of exactly 0 counts here."""
    yes = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return (
        yes(e["signature_hit"], 3) + yes(F.coalesce(e["entropy"], F.lit(0.0)) >= 2.0, 2) + yes(F.coalesce(e["top_choice_margin"], F.lit(1.0)) <= 0.1, 2)
        + yes(F.coalesce(e["sample_disagreement"], F.lit(0.0)) >= 0.5, 2) + yes(F.coalesce(e["model_disagreement"], F.lit(0.0)) >= 0.5, 2)
        + yes(e["external_side_effect"], 3) + yes(e["red_team_generated"], 1)
    )


def route(score: Column) -> Column:
    return F.when(score >= 9, "auto_promote_patch_candidate").when(score >= 5, "agentic_review_queue").otherwise("aggregate_watch")


def events_of(nodes: DataFrame) -> DataFrame:
    """The events that nodes carry, as flat rows (node_id, e)."""
    return nodes.select("node_id", F.explode("events").alias("e"))


def scored_events(events: DataFrame) -> DataFrame:
    """Score and route of flat events(node_id, e)."""
    e = events.withColumn("score", event_score(F.col("e")))
    return e.select("node_id", F.col("e.event_id").alias("event_id"), F.col("e.category").alias("category"), "score", route(F.col("score")).alias("route"))


def network_counts(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of routes, categories, patch channels and modes of nodes and their flat events; each table is read once.

    A node with a third of all events is no row of its own: counts fold where events lie.
    """
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    of_nodes = nodes.select(F.explode(F.array(pair("patch_channel", F.col("patch_channel")), pair("mode", F.col("mode")), pair("total", F.lit("nodes")))).alias("p"))
    of_events = events.select(F.explode(F.array(pair("route", route(event_score(F.col("e")))), pair("category", F.col("e.category")), pair("total", F.lit("events")))).alias("p"))
    return of_nodes.union(of_events).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def raw_field_paths(schema: T.DataType, path: str = "$") -> list[str]:
    """Paths of forbidden field names anywhere in a schema; [*] stands for array elements."""
    if isinstance(schema, T.StructType):
        out = []
        for f in schema.fields:
            at = f"{path}.{f.name}"
            out += [at] * (f.name in RAW_FIELD_NAMES) + raw_field_paths(f.dataType, at)
        return out
    if isinstance(schema, T.ArrayType):
        return raw_field_paths(schema.elementType, f"{path}[*]")
    return []


def raw_fields_in_json(text: Column) -> Column:
    """Forbidden names that occur as keys in a JSON text, at any depth."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf'"{name}"\s*:'), F.lit(name)) for name in RAW_FIELD_NAMES]))


def unsafe_event(e: Column) -> Column:
    return F.coalesce(e["contains_raw_content"], F.lit(False)) | F.coalesce(e["contains_private_data"], F.lit(False))


def privacy_violations(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """(subject, reason) of everything in nodes and their flat events that must not be shared."""
    no, hit = F.lit(False), lambda c, why: F.when(c, F.struct(F.col("node_id").alias("subject"), F.lit(why).alias("reason")))
    p = F.col("privacy")
    of_node = F.array(hit(F.coalesce(p["raw_upload_enabled"], no), "enables raw upload"), hit(~F.coalesce(p["aggregate_only"], no), "is not aggregate-only"), hit(F.coalesce(p["private_data_leaves_device"], no), "leaks private data"))
    found = nodes.select(F.explode(F.array_compact(of_node)).alias("v")).select("v.*")
    return found.union(events.where(unsafe_event(F.col("e"))).select(F.col("e.event_id").alias("subject"), F.lit("is not safe to aggregate").alias("reason")))


def assert_privacy_safe(nodes: DataFrame) -> DataFrame:
    """The nodes, which fail to evaluate where one is not safe to share."""
    if found := raw_field_paths(nodes.schema):
        raise ValueError(f"raw fields are not allowed in shared data: {found}")
    p, no = F.col("privacy"), F.lit(False)
    bad = F.coalesce(p["raw_upload_enabled"], no) | ~F.coalesce(p["aggregate_only"], no) | F.coalesce(p["private_data_leaves_device"], no)
    bad = bad | F.exists(F.coalesce("events", F.array()), unsafe_event)
    return nodes.where(F.when(bad, F.raise_error(F.concat("node_id", F.lit(" is not safe to share")))).otherwise(F.lit(True)))
