"""Reports: one renderer for small aggregate tables, and the reports made of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


def percent(x: float | None) -> str:
    return "n/a" if x is None or x != x else f"{100 * x:.1f}%"


def interval(lo: float | None, hi: float | None) -> str:
    return f"[{percent(lo)}, {percent(hi)}]"


def counts(found: dict[str, int]) -> str:
    """Counts by name, most frequent first, ties by name."""
    return ", ".join(f"{k}: {n}" for k, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))) or "none"


def sources(found: list[Any]) -> str:
    """Links to labelled addresses."""
    return "; ".join(f"[{s['label']}]({s['url']})" for s in found)


def bullets(items: list[str]) -> str:
    return "\n".join(f"- {x}" for x in items)


def cell(v: Any) -> str:
    if v is None:
        return "-"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, float):
        return "n/a" if v != v else f"{v:.4g}"
    if isinstance(v, (list, tuple)):
        return ", ".join(map(cell, v)) or "-"
    return str(v).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, order: list | None = None) -> str:
    """A Markdown table of an aggregate."""
    return "\n".join(lines(df, order))


def lines(df: DataFrame, order: list | None = None) -> Iterator[str]:
    """The lines of a Markdown table; rows come one partition at a time, however many they are."""
    yield "| " + " | ".join(df.columns) + " |"
    yield "|" + "---|" * len(df.columns)
    for r in (df.orderBy(*order) if order else df).toLocalIterator():
        yield "| " + " | ".join(map(cell, r)) + " |"


@dataclass
class Section:
    title: str
    table: DataFrame
    order: list | None = None
    note: str = ""


def report(title: str, sections: list[Section]) -> Iterator[str]:
    """The lines of a report; the driver holds a partition of a table at a time, never a whole one."""
    yield f"# {title}"
    for s in sections:
        yield from ("", f"## {s.title}", "", *([s.note, ""] if s.note else []))
        yield from lines(s.table, s.order)


# Headings, names and order of what a patch-loop report shows; a name in capitals is shown as code.
LOOP = ["safe signal summary", "risk-delta cell", "safe probe", "observable run summary", "sentinel event", "decision trace summary", "patch object", "residual monitor"]
LOOP_STATUS = "Status: synthetic public-safe patch-loop case"
LOOP_NOTE = "No raw exploit content is preserved. The useful artifact is the operating loop, not the prompt content."
LOOP_PARTS = [
    ("Source Signal", "source_signal", [("Source type", "source_type"), ("Confidence", "source_confidence"), ("Raw-detail policy", "RAW_DETAIL_POLICY"), ("Summary", "summary")], None),
    ("Risk-Delta Cell", "risk_delta_cell", [("Capability delta", "capability_delta"), ("Risk class", "risk_class"), ("Shared surfaces", "shared_surfaces"), ("Why it matters", "why_it_matters")], None),
    ("Safe Probe", "safe_probe", [("Probe", "PROBE_ID"), ("Description", "description")], ("Safety controls:", "safety_controls", None)),
    ("Observable Run Summary", "observable_run_summary", [("Target task", "target_task"), ("Observed failure mode", "observed_failure_mode"), ("First useful intervention", "FIRST_USEFUL_INTERVENTION"), ("Affected controls", "affected_controls")], None),
    ("Sentinel Event", "sentinel_event", [("Stage", "STAGE"), ("Category", "CATEGORY"), ("Severity", "SEVERITY"), ("Signal", "signal"), ("Recommended action", "recommended_action")], None),
    ("Decision Trace Summary", "decision_trace_summary", [("Owner", "owner"), ("Decision needed", "decision_needed"), ("Residual risk", "residual_risk")], None),
    ("Patch Object", "patch_object", [("Type", "TYPE"), ("Description", "description"), ("Verification", "verification"), ("Rollout note", "rollout_note")], None),
    ("Residual Monitor", "residual_monitor", [("Monitor", "MONITOR_ID")], ("Metrics:", "metrics", ("Reopen trigger: ", "reopen_trigger"))),
]
# End of fixed values.


def patch_loop(case: dict[str, Any]) -> str:
    """The report of one patch-loop case, its parts in the loop's order."""

    def shown(part: dict[str, Any], key: str) -> str:
        value = part[key.lower()]
        text = ", ".join(value) if isinstance(value, list) else value
        return f"`{text}`" if key.isupper() else text

    loop = "\n  -> ".join(LOOP)
    blocks = [f"# {case['title']}", f"Case: `{case['case_id']}`  \n{LOOP_STATUS}", "## Caveat", case["caveat"], LOOP_NOTE, "## Loop", f"```text\n{loop}\n```"]
    for title, key, rows, more in LOOP_PARTS:
        blocks += [f"## {title}", bullets([f"{name}: {shown(case[key], field)}" for name, field in rows])]
        if more:
            label, field, last = more
            blocks += [label, bullets(case[key][field])]
            if last:
                blocks.append(last[0] + case[key][last[1]])
    return "\n\n".join(blocks) + "\n"
