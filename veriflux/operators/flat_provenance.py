"""Taint closure, approvals and alerts over flat step tables: a trace may have any number of steps.

`provenance` folds over a trace that is one row; here a step is a row
(trace_id, idx, step_id, source, type, content, tool, privileged, derived_from,
approves), and a trace is spread over as many tasks as it needs.

- A parent's name means the last earlier step of that name: an as-of join.
- The closure is the least fixpoint of a relation, computed semi-naively: only
  what the last round found is joined with the edges again. Before that, steps
  that just hand on what one parent has are contracted by pointer jumping, so a
  chain costs a logarithm of its length in rounds; what stays is a round for
  each level of the contracted graph.
- An approval covers an action if the last covering one before it is not before
  the action's first root: an as-of join again, without a scan for each action.
- Paths are a breadth-first search of all alerts at once, a round for each level.

Rounds are written to the shared folder, so lineage ends at each.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .asof import as_of
from .provenance import CRITICAL_TOOLS, PRIVILEGED_TOOLS, TAINTED_SOURCES

NAMES = "array<string>"


def flat_steps(steps: DataFrame) -> DataFrame:
    """Steps with defaults filled in and privilege derived from the flag or the tool; fields may be missing."""
    have = set(steps.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    text = lambda c, d: F.coalesce(col(c, "string"), F.lit(d)).alias(c)
    names = lambda c: F.coalesce(col(c, NAMES), F.array().cast(NAMES)).alias(c)
    privileged = F.coalesce(col("privileged", "boolean"), F.lit(False)) | F.coalesce(col("tool", "string"), F.lit("")).isin(PRIVILEGED_TOOLS)
    return steps.select(
        "trace_id", F.col("idx").cast("long").alias("idx"), F.col("step_id").cast("string").alias("step_id"), text("source", "user"), text("type", "message"), text("content", ""), text("tool", ""),
        privileged.alias("privileged"), names("derived_from"), names("approves"),
    )


def exploded(traces: DataFrame) -> DataFrame:
    """Flat steps of nested traces."""
    return flat_steps(traces.select("trace_id", F.posexplode("steps").alias("idx", "s")).select("trace_id", "idx", "s.*"))


def named_edges(steps: DataFrame) -> DataFrame:
    """(trace_id, child, child_idx, parent, parent_idx) for data-flow edges: a name means the last earlier step that has it, and approvals neither inherit nor pass on."""
    asked = steps.where("type <> 'approval'").select("trace_id", F.col("step_id").alias("child"), "idx", F.explode(F.array_distinct("derived_from")).alias("parent"))
    named = steps.select("trace_id", F.col("step_id").alias("parent"), "idx", F.col("idx").alias("parent_idx"), F.col("type").alias("parent_type"))
    found = as_of(asked, named, ["trace_id", "parent"], "idx", ["parent_idx", "parent_type"], strict=True)
    return found.where("parent_type <> 'approval'").select("trace_id", "child", F.col("idx").alias("child_idx"), "parent", "parent_idx")


def flat_edges(steps: DataFrame) -> DataFrame:
    """named_edges() by places alone."""
    return named_edges(steps).select("trace_id", F.col("child_idx").alias("child"), F.col("parent_idx").alias("parent")).distinct()


def tainted(source: Column) -> Column:
    return source.isin(TAINTED_SOURCES)


def contracted(steps: DataFrame, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(trace_id, idx, anchor) of steps that add nothing to their one parent; the anchor is the nearest ancestor that is not such a step.

    Pointer jumping: every round doubles the length of what is skipped.
    """
    single = edges.groupBy("trace_id", F.col("child").alias("idx")).agg(F.count("*").alias("n"), F.min("parent").alias("anchor")).where("n = 1").drop("n")
    plain = steps.where(~tainted(F.col("source"))).select("trace_id", "idx")
    jumps = tmp.save(single.join(plain, ["trace_id", "idx"], "left_semi"), "jump-0")
    for k in count(1):
        further = jumps.select("trace_id", F.col("idx").alias("anchor"), F.col("anchor").alias("further"))
        both = jumps.join(further, ["trace_id", "anchor"], "left")
        jumps = tmp.save(both.select("trace_id", "idx", F.coalesce("further", "anchor").alias("anchor"), F.col("further").isNotNull().alias("moved")), f"jump-{k}")
        moved = jumps.where("moved").limit(1).count()
        jumps = jumps.drop("moved")
        if not moved:
            return jumps
        tmp.drop(f"jump-{k - 1}")


def closure(steps: DataFrame, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(trace_id, idx, root) for every step and each of its taint roots, which are names of steps."""
    jumps = contracted(steps, edges, tmp)
    up = jumps.select("trace_id", F.col("idx").alias("parent"), "anchor")
    inner = edges.join(jumps.select("trace_id", F.col("idx").alias("child")), ["trace_id", "child"], "left_anti")
    inner = inner.join(up, ["trace_id", "parent"], "left").select("trace_id", "child", F.coalesce("anchor", "parent").alias("parent")).distinct()
    inner = tmp.save(inner, "inner")
    own = steps.where(tainted(F.col("source"))).select("trace_id", "idx", F.col("step_id").alias("root"), (F.col("type") == "approval").alias("approval"))
    reach = delta = tmp.save(own.where("not approval").drop("approval").distinct(), "reach-0")
    for k in count(1):
        step = delta.join(inner.withColumnRenamed("parent", "idx"), ["trace_id", "idx"]).select("trace_id", F.col("child").alias("idx"), "root").distinct()
        delta = tmp.save(step.join(reach, ["trace_id", "idx", "root"], "left_anti"), f"reach-{k}")
        if not delta.limit(1).count():
            break
        reach = reach.union(delta)
    handed = jumps.join(reach.withColumnRenamed("idx", "anchor"), ["trace_id", "anchor"]).select("trace_id", "idx", "root")
    return reach.union(handed).union(own.where("approval").drop("approval").distinct())


def taint_roots(steps: DataFrame) -> DataFrame:
    """(trace_id, idx, step_id, roots): the sorted roots of each step that has any."""
    tmp = Scratch(steps.sparkSession, "taint")
    steps = tmp.save(flat_steps(steps), "steps")
    reach = closure(steps, tmp.save(flat_edges(steps), "edges"), tmp)
    roots = reach.groupBy("trace_id", "idx").agg(F.array_sort(F.collect_set("root")).alias("roots"))  # as many as the step has roots
    result = tmp.save(roots.join(steps.select("trace_id", "idx", "step_id"), ["trace_id", "idx"]), "result")
    tmp.keep("result")
    return result


def covered(actions: DataFrame, steps: DataFrame) -> DataFrame:
    """actions(trace_id, idx, tool, first), each with `approved`: the place of the last approval before it that covers its tool, or null.

    An approval that names no tool, or "*", covers all.
    """
    blanket = (F.size("approves") == 0) | F.array_contains("approves", "*")
    given = steps.where("type = 'approval'").select("trace_id", "idx", F.explode(F.when(blanket, F.array(F.lit("*"))).otherwise(F.array_distinct("approves"))).alias("name"), F.col("idx").alias("approved"))
    asked = actions.select("trace_id", "idx", F.explode(F.array_distinct(F.array("tool", F.lit("*")))).alias("name"))
    last = as_of(asked, given, ["trace_id", "name"], "idx", ["approved"], strict=True).groupBy("trace_id", "idx").agg(F.max("approved").alias("approved"))
    return actions.join(last, ["trace_id", "idx"], "left")


def paths(open_: DataFrame, steps: DataFrame, tmp: Scratch) -> DataFrame:
    """(trace_id, idx, path): the shortest path from a root to each open action along derived_from; ties fall to the edge listed first.

    Here a name means the trace's last step that has it. All searches go on
    together; `order` lists the edges' places, and sorts a level as a queue would.
    Without a path: the roots, then the action.
    """
    parents = tmp.save(steps.groupBy("trace_id", F.col("step_id").alias("id")).agg(F.max_by("derived_from", "idx").alias("derived_from")), "parents")
    level = open_.select("trace_id", "idx", F.col("step_id").alias("id"), F.array("step_id").alias("path"), F.array().cast("array<int>").alias("order"))
    key, seen, found = ["trace_id", "idx"], None, []
    roots = open_.select(*key, "roots")
    for k in count():
        level = tmp.save(level.join(roots, key).withColumn("hit", F.array_contains("roots", F.col("id"))).drop("roots"), f"level-{k}")
        found.append(level.where("hit").groupBy(*key).agg(F.min_by("path", "order").alias("path")))
        seen = level.select(*key, "id") if seen is None else seen.union(level.select(*key, "id"))
        on = level.join(found[-1], key, "left_anti").join(parents, ["trace_id", "id"])
        on = on.select(*key, "path", "order", F.posexplode("derived_from").alias("at", "id"))
        on = on.groupBy(*key, "id").agg(F.min(F.struct(F.concat("order", F.array("at")).alias("order"), F.concat(F.array("id"), "path").alias("path"))).alias("s"))
        level = on.join(seen, [*key, "id"], "left_anti").select(*key, "id", "s.path", "s.order")
        level = tmp.save(level, f"next-{k}")
        if not level.limit(1).count():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    fallback = F.concat(F.array_sort("roots"), F.array("step_id"))
    return open_.select(*key, "roots", "step_id").join(every, key, "left").select(*key, F.coalesce("path", fallback).alias("path"))


def flat_alerts(steps: DataFrame) -> DataFrame:
    """trace_id, step_id, idx, tool, severity, taint_sources, taint_path of each privileged, tainted tool call without a covering approval since its first root."""
    tmp = Scratch(steps.sparkSession, "gate")
    steps = tmp.save(flat_steps(steps), "steps")
    reach = closure(steps, tmp.save(flat_edges(steps), "edges"), tmp)
    calls = steps.where((F.col("type") == "tool_call") & F.col("privileged")).select("trace_id", "idx", "step_id", "tool")
    places = steps.groupBy("trace_id", F.col("step_id").alias("root")).agg(F.min("idx").alias("place"))
    actions = reach.join(calls, ["trace_id", "idx"]).join(places, ["trace_id", "root"]).groupBy("trace_id", "idx", "step_id", "tool")
    actions = tmp.save(actions.agg(F.array_sort(F.collect_set("root")).alias("roots"), F.min("place").alias("first")), "actions")
    decided = covered(actions.select("trace_id", "idx", "tool", "first"), steps).where("approved is null or approved < first")
    open_ = tmp.save(actions.join(decided.select("trace_id", "idx"), ["trace_id", "idx"], "left_semi"), "open")
    shown = open_.drop("first").join(paths(open_, steps, tmp), ["trace_id", "idx"])
    severity = F.when(F.col("tool").isin(CRITICAL_TOOLS), "critical").otherwise("high")
    result = tmp.save(shown.select("trace_id", "step_id", F.col("idx").cast("int").alias("idx"), "tool", severity.alias("severity"), F.col("roots").alias("taint_sources"), F.col("path").alias("taint_path")), "result")
    tmp.keep("result")
    return result
