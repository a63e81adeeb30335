"""Queries over derived agent records: sentinel, monitor, network, gate, behavior, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import class_metrics
from ..functions.patterns import EXFILTRATION, INJECTION_SIGNALS, NAIVE, PROMPT_INJECTION, SECRET, any_of, portable
from ..functions.text import matches, matching, text_hash
from ..operators import behavior, flat_provenance, monitor, network, provenance, sentinel, validate
from . import derived
from .derived import ALERTS_SQL, ARGS, CONNECTOR, STEPS_SQL, TOOL, plant
from .registry import ORACLES, query, sql_text, table, texts

TEXT = "coalesce(text, '')"


def rx(text: str, patterns: list[str]) -> str:
    return f"regexp_matches(lower({text}), {sql_text('(?i)' + any_of(patterns))})"


# ---- sentinel -------------------------------------------------------------

_P0, _P3 = f"({TEXT} || {plant(0)})", f"({TEXT} || {plant(3)})"
_PLAN, _DRAFT, _FINAL = f"('plan' || {plant(5)})", f"('draft' || {plant(7)})", f"('final' || {plant(2)})"


def _ev(stage: str, ord_: int, seq: int, category: str, severity: str, evidence: str, cond: str, told: str = "", about: str = "") -> str:
    signal, action = sentinel.TOLD[told or category]
    return f"SELECT CAST(doc_id AS VARCHAR) AS run_id, '{stage}' AS stage, {ord_} AS stage_ord, {seq} AS seq, '{category}' AS category, '{severity}' AS severity, {sql_text(signal.replace('%s', about))} AS signal, substr(sha256({evidence}), 1, 16) AS evidence_hash, {sql_text(action)} AS recommended_action FROM documents WHERE {cond}"


_OPEN = "doc_id % 3 IN (0, 1)"
EVENTS_SQL = " UNION ALL ".join([
    _ev("ingress", 0, 0, "prompt_injection", "high", _P0, rx(_P0, PROMPT_INJECTION), "prompt"),
    _ev("ingress", 0, 1, "prompt_injection", "high", _P3, f"{_OPEN} AND {rx(_P3, PROMPT_INJECTION)}", "context_injection", "web"),
    _ev("ingress", 0, 2, "data_exfiltration", "high", _P3, f"{_OPEN} AND {rx(_P3, EXFILTRATION)}", "context_exfiltration", "web"),
    _ev("trajectory", 1, 0, "goal_drift", "high", _PLAN, rx(_PLAN, PROMPT_INJECTION + EXFILTRATION)),
    _ev("trajectory", 1, 6, "tool_overreach", "critical", f"('tool=' || {TOOL})", f"doc_id % 4 <> 0 AND {TOOL} NOT IN ('read_file', 'send_email')"),
    _ev("trajectory", 1, 7, "missing_approval", "high", f"('tool=' || {TOOL} || ', connector=' || {CONNECTOR})", f"(doc_id % 5 = 2 OR {TOOL} = 'transfer_funds') AND doc_id % 7 <> 0"),
    _ev("trajectory", 1, 8, "connector_data_boundary", "high", f"('tool=' || {TOOL} || '; connector=' || {CONNECTOR})", f"{CONNECTOR} <> '' AND doc_id % 5 <> 0 AND (doc_id % 5 = 1 OR {CONNECTOR} NOT IN ('email', 'crm')) AND (doc_id % 2 = 0 OR {TOOL} = 'transfer_funds')"),
    _ev("trajectory", 1, 14, "unstable_action_selection", "medium", "'telemetry'", "(doc_id % 5) * 0.75 >= 2.0 AND doc_id % 3 <> 0 AND (doc_id % 3) * 0.05 <= 0.1 AND (doc_id % 4) * 0.25 >= 0.5"),
    _ev("draft", 2, 0, "data_leakage", "high", _DRAFT, rx(_DRAFT, SECRET), "draft_secret", "draft"),
    _ev("draft", 2, 1, "unsafe_action_proposal", "medium", _DRAFT, rx(_DRAFT, EXFILTRATION), "draft_exfiltration", "draft"),
    _ev("final", 3, 0, "data_leakage", "critical", _FINAL, rx(_FINAL, SECRET), "final_secret"),
    _ev("final", 3, 1, "unsafe_action_disclosure", "medium", _FINAL, rx(_FINAL, EXFILTRATION), "final_exfiltration"),
])


@query(EVENTS_SQL)
def sentinel_events(spark: SparkSession, d: str) -> DataFrame:
    return sentinel.events(derived.runs(spark, d)).select("run_id", "stage", "stage_ord", "seq", "category", "severity", "signal", text_hash(F.col("evidence")).alias("evidence_hash"), "recommended_action")


REPORT_SQL = f"""e AS ({EVENTS_SQL}),
r AS (SELECT CAST(doc_id AS VARCHAR) AS run_id, 'm' || doc_id % 3 AS model FROM documents),
g AS (SELECT run_id, count(*) AS n, min_by(stage, stage_ord) AS first, {', '.join(f"count(*) FILTER (stage = '{s}') AS n_{s}" for s in sentinel.STAGES)},
  {', '.join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in ('critical', 'high', 'medium'))}, list_sort(list(DISTINCT category)) AS categories FROM e GROUP BY run_id),
rep AS (SELECT r.run_id, model, n IS NOT NULL AS risk_present, coalesce(first, 'none') AS first_detection_stage, {', '.join(f"CAST(coalesce(n_{s}, 0) AS INTEGER) AS n_{s}" for s in (*sentinel.STAGES, 'critical', 'high', 'medium'))},
  coalesce(categories, []) AS categories, CAST(coalesce(n, 0) AS INTEGER) AS n_events FROM r LEFT JOIN g USING (run_id))"""


@query(f"WITH {REPORT_SQL} SELECT * FROM rep")
def sentinel_run_report(spark: SparkSession, d: str) -> DataFrame:
    return sentinel.run_reports(derived.runs(spark, d))


@query(f"WITH {REPORT_SQL} SELECT first_detection_stage, count(*) AS n_runs, count(*) FILTER (risk_present) AS n_risky, CAST(sum(n_events) AS BIGINT) AS n_events FROM rep GROUP BY ROLLUP (first_detection_stage)")
def sentinel_summary(spark: SparkSession, d: str) -> DataFrame:
    return sentinel.summary(derived.runs(spark, d))


def _ablate(name: str, stages: list[str]) -> str:
    n = " + ".join(f"n_{s}" for s in stages)
    return f"SELECT '{name}' AS condition, count(*) FILTER ({n} > 0) AS detected_runs, CAST(sum({n}) AS BIGINT) AS n_events FROM rep"


@query(f"WITH {REPORT_SQL} " + " UNION ALL ".join(_ablate(k, v) for k, v in sentinel.CONDITIONS.items()))
def stage_ablation(spark: SparkSession, d: str) -> DataFrame:
    return sentinel.ablation(derived.runs(spark, d))


# ---- monitor --------------------------------------------------------------

_OUT = f"('out' || {plant(6)})"
_SRC = "CASE WHEN doc_id % 2 = 0 THEN 'retrieved:web' ELSE 'retrieved:unknown' END"


def _first(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {sql_text('(?i)' + portable(p))}) THEN {sql_text(p)}" for p in patterns) + " END"


def _mon(rule: monitor.Rule, stage: str, match: str, evidence: str) -> str:
    return f"SELECT doc_id, '{rule.signature_id}' AS signature_id, '{rule.category}' AS category, '{rule.severity}' AS severity, {stage} AS stage, {match} AS match, {evidence} AS ev FROM documents"


def _monitor_sql() -> str:
    parts, by = [], {r.signature_id: r for r in monitor.RULES}
    for key in ("ARA-PI-001", "ARA-SE-001"):
        r = by[key]
        parts += [_mon(r, "'input'", _first(_P0, r.patterns), _P0), _mon(r, _SRC, _first(_P3, r.patterns), _P3), _mon(r, "'output'", _first(_OUT, r.patterns), _OUT)]
    r = by["ARA-DL-001"]
    parts.append(_mon(r, "'output'", _first(_OUT, r.patterns), _OUT))
    call = f"('approval=' || CASE WHEN doc_id % 7 = 0 THEN 'true' ELSE 'false' END || ';args=' || {ARGS} || ';connector=' || {CONNECTOR} || ';external_side_effect=' || CASE WHEN doc_id % 5 = 2 THEN 'true' ELSE 'false' END || ';tool=' || {TOOL})"
    parts.append(_mon(by["ARA-TC-001"], "'tool_call'", "CASE WHEN doc_id % 5 = 2 AND doc_id % 7 <> 0 THEN 'tool-condition' END", call))
    parts.append(_mon(by["ARA-CB-001"], "'tool_call'", "CASE WHEN doc_id % 2 = 0 THEN 'tool-condition' END", call))
    tele = "CASE WHEN (doc_id % 5) * 0.75 >= 2.0 AND doc_id % 3 <> 0 AND (doc_id % 4) * 0.25 >= 0.5 THEN 'telemetry-threshold' END"
    parts.append(_mon(by["ARA-TM-001"], "'telemetry'", tele, "(CAST((doc_id % 4) * 0.25::DOUBLE AS VARCHAR) || ',' || CAST((doc_id % 5) * 0.75::DOUBLE AS VARCHAR) || ',' || CAST((doc_id % 3) * 0.05::DOUBLE AS VARCHAR))"))
    clean = r"trim(regexp_replace(ev, '[\s\x{0B}\x{85}\x{A0}]+', ' ', 'g'))"
    return f"""ev AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'm1' END AS model, signature_id, category, severity, stage, match,
  substr({clean}, 1, 160) AS evidence_excerpt, substr(sha256(ev), 1, 16) AS evidence_hash FROM ({' UNION ALL '.join(parts)}) WHERE match IS NOT NULL)"""


MONITOR_SQL = _monitor_sql()


_NAMED = ", ".join("CASE signature_id " + " ".join(f"WHEN '{r.signature_id}' THEN {sql_text(getattr(r, field))}" for r in monitor.RULES) + f" END AS {name}" for field, name in (("name", "signature_name"), ("recommended_action", "recommended_action")))


@query(f"WITH {MONITOR_SQL} SELECT *, {_NAMED} FROM ev")
def monitor_events(spark: SparkSession, d: str) -> DataFrame:
    return monitor.monitor_events(derived.sessions(spark, d)).drop("event_ord")


@query(f"""WITH {MONITOR_SQL} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM ev GROUP BY category UNION ALL SELECT 'severity', severity, count(*) FROM ev GROUP BY severity
 UNION ALL SELECT 'signature', signature_id, count(*) FROM ev GROUP BY signature_id UNION ALL SELECT 'total', 'all', count(*) FROM ev""")
def monitor_summary(spark: SparkSession, d: str) -> DataFrame:
    return monitor.monitor_summary(monitor.monitor_events(derived.sessions(spark, d)))


@query(f"""WITH {MONITOR_SQL} SELECT 'aggregate_only_no_raw_prompt_output_or_tool_args' AS privacy_policy, count(*) AS source_event_count, count(DISTINCT session_id) AS affected_session_count,
 list_sort(list(DISTINCT signature_id)) AS signature_ids, list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT severity)) AS severities FROM ev""")
def privacy_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return monitor.privacy_aggregate(monitor.monitor_events(derived.sessions(spark, d)))


@query(f"WITH {MONITOR_SQL} SELECT signature_id, category, severity, stage, evidence_hash FROM ev")
def event_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return monitor.fingerprints(monitor.monitor_events(derived.sessions(spark, d)))


# ---- network --------------------------------------------------------------

SCORED_SQL = """sc AS (SELECT *, CASE WHEN score >= 9 THEN 'auto_promote_patch_candidate' WHEN score >= 5 THEN 'agentic_review_queue' ELSE 'aggregate_watch' END AS route FROM (
 SELECT user_id, event_id, event_type, CAST((CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END) + (CASE WHEN event_id % 4 >= 2 THEN 2 ELSE 0 END) + (CASE WHEN event_id % 3 <= 1 THEN 2 ELSE 0 END) + (CASE WHEN event_id % 5 >= 2 THEN 2 ELSE 0 END)
  + (CASE WHEN event_id % 7 >= 4 THEN 2 ELSE 0 END) + (CASE WHEN event_id % 3 = 1 THEN 3 ELSE 0 END) + (CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS score FROM events))"""


@query(f"WITH {SCORED_SQL} SELECT 'N' || user_id AS node_id, CAST(event_id AS VARCHAR) AS event_id, event_type AS category, score, route FROM sc")
def telemetry_score(spark: SparkSession, d: str) -> DataFrame:
    return network.scored_events(derived.node_events(spark, d))


@query(f"""WITH {SCORED_SQL}, u AS (SELECT DISTINCT user_id FROM events)
SELECT 'route' AS dimension, route AS value, count(*) AS n FROM sc GROUP BY route UNION ALL SELECT 'category', event_type, count(*) FROM sc GROUP BY event_type UNION ALL SELECT 'total', 'events', count(*) FROM sc
UNION ALL SELECT 'total', 'nodes', count(*) FROM u UNION ALL SELECT 'mode', CASE user_id % 2 WHEN 0 THEN 'local' ELSE 'shared' END, count(*) FROM u GROUP BY 2
UNION ALL SELECT 'patch_channel', CASE user_id % 3 WHEN 0 THEN 'stable' ELSE 'canary' END, count(*) FROM u GROUP BY 2""")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    return network.network_counts(derived.nodes(spark, d), derived.node_events(spark, d))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT 'N' || user_id AS subject, 'enables raw upload' AS reason FROM u WHERE user_id % 10 = 3 UNION ALL SELECT 'N' || user_id, 'is not aggregate-only' FROM u WHERE user_id % 10 = 4
UNION ALL SELECT 'N' || user_id, 'leaks private data' FROM u WHERE user_id % 10 = 5 UNION ALL SELECT CAST(event_id AS VARCHAR), 'is not safe to aggregate' FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0""")
def privacy_violations(spark: SparkSession, d: str) -> DataFrame:
    return network.privacy_violations(derived.nodes(spark, d), derived.node_events(spark, d))


@query("""SELECT event_id, CASE WHEN contains(props, '"raw_prompt"') THEN ['raw_prompt'] ELSE [] END AS raw_fields FROM (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN '{"a": {"raw_prompt": 1}}' ELSE props END AS props FROM events)""")
def raw_fields(spark: SparkSession, d: str) -> DataFrame:
    props = F.expr("""CASE WHEN event_id % 31 = 0 THEN '{"a": {"raw_prompt": 1}}' ELSE props END""")
    return table(spark, d, "events").select("event_id", network.raw_fields_in_json(props).alias("raw_fields"))


# ---- provenance gate ------------------------------------------------------


@query(f"WITH RECURSIVE {STEPS_SQL} SELECT t AS trace_id, 's' || i AS step_id, list_sort(list('s' || root)) AS roots FROM cl GROUP BY t, i")
def taint_closure(spark: SparkSession, d: str) -> DataFrame:
    steps = provenance.with_taint(provenance.parse_steps(derived.traces(spark, d))).select("trace_id", F.explode("steps").alias("s"))
    return steps.where(F.size("s.roots") > 0).select("trace_id", F.col("s.step_id").alias("step_id"), F.col("s.roots").alias("roots"))


@query(f"WITH RECURSIVE {STEPS_SQL} SELECT t AS trace_id, i AS idx, 's' || i AS step_id, list_sort(list('s' || root)) AS roots FROM cl GROUP BY t, i")
def flat_taint_closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure as a fixpoint over flat steps."""
    return flat_provenance.taint_roots(derived.steps(spark, d))


@query(f"WITH RECURSIVE {STEPS_SQL} SELECT t AS trace_id, 's' || i AS child, CAST(i AS INTEGER) AS child_idx, 's' || j AS parent, CAST(j AS INTEGER) AS parent_idx FROM ed")
def provenance_edges(spark: SparkSession, d: str) -> DataFrame:
    e = flat_provenance.named_edges(flat_provenance.flat_steps(derived.steps(spark, d)))
    return e.withColumns({c: F.col(c).cast("int") for c in ("child_idx", "parent_idx")})


PATHS_SQL = f"""{ALERTS_SQL},
pa AS (SELECT al.t, al.i, al.roots, al.i AS node, ['s' || al.i] AS path, CAST([] AS BIGINT[]) AS pos FROM al
  UNION ALL SELECT pa.t, pa.i, pa.roots, e.j, list_prepend('s' || e.j, pa.path), list_append(pa.pos, e.k)
  FROM pa JOIN (SELECT t, i, unnest(parents) AS j, generate_subscripts(parents, 1) AS k FROM st) e ON e.t = pa.t AND e.i = pa.node
  WHERE NOT list_contains(pa.roots, 's' || pa.node) AND NOT list_contains(pa.path, 's' || e.j)),
best AS (SELECT t, i, arg_min(path, {{'n': len(path), 'p': pos}}) AS path FROM pa WHERE list_contains(roots, 's' || node) GROUP BY t, i)"""


@query(f"""{PATHS_SQL} SELECT al.t AS trace_id, al.sid AS step_id, CAST(al.i AS INTEGER) AS idx, al.tool, CASE WHEN al.tool IN ('transfer_funds', 'modify_permissions', 'delete') THEN 'critical' ELSE 'high' END AS severity,
 al.roots AS taint_sources, best.path AS taint_path FROM al JOIN best ON best.t = al.t AND best.i = al.i""")
def gate_alerts(spark: SparkSession, d: str) -> DataFrame:
    return provenance.alerts(derived.traces(spark, d))


@query(ORACLES["gate_alerts"])
def flat_gate_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts over flat steps: approvals by an as-of join, paths by a search of all alerts at once."""
    return flat_provenance.flat_alerts(derived.steps(spark, d))


@query(f"{ALERTS_SQL} SELECT tool, CASE WHEN tool IN ('transfer_funds', 'modify_permissions', 'delete') THEN 'critical' ELSE 'high' END AS severity, count(*) AS n_alerts, count(DISTINCT t) AS n_traces FROM al GROUP BY 1, 2")
def gate_alert_counts(spark: SparkSession, d: str) -> DataFrame:
    return provenance.alerts(derived.traces(spark, d)).groupBy("tool", "severity").agg(F.count("*").alias("n_alerts"), F.count_distinct("trace_id").alias("n_traces"))


@query(f"{PATHS_SQL} SELECT 'GATE-' || al.t || '-' || al.sid AS record_id, 'Tainted privileged action: ' || al.tool AS title, 'tool_calling' AS agentic_surface, 'prompt_injection' AS risk_category, CASE WHEN al.tool IN ('transfer_funds', 'modify_permissions', 'delete') THEN 'critical' ELSE 'high' END AS severity, 'Taint path: ' || array_to_string(best.path, ' -> ') AS observed_behavior, 'before_external_side_effect' AS approval_gate FROM al JOIN best ON best.t = al.t AND best.i = al.i")
def gate_decision_records(spark: SparkSession, d: str) -> DataFrame:
    return provenance.decision_records(provenance.alerts(derived.traces(spark, d)))


_CONTENT = "string_agg(content, ' ' ORDER BY i)"
_HITS = " + ".join(f"CAST(regexp_matches(lower(c), {sql_text(portable(p))}) AS INTEGER)" for p in PROMPT_INJECTION)
GATE_SQL = f"""{ALERTS_SQL},
tr AS (SELECT t, {_CONTENT} AS c FROM st GROUP BY t), n AS (SELECT t, count(*) AS k FROM al GROUP BY t),
res AS (SELECT tr.t AS trace_id, CAST(substr(tr.t, 2) AS BIGINT) % 2 = 0 AS expected_gate_alert, coalesce(k, 0) > 0 AS gate_fires, CAST(coalesce(k, 0) AS INTEGER) AS alert_count, ({_HITS}) > 0 AS detector_fires, CAST(({_HITS}) AS INTEGER) AS detector_hits FROM tr LEFT JOIN n ON n.t = tr.t)"""


@query(f"{GATE_SQL} SELECT *, gate_fires = expected_gate_alert AS gate_correct, detector_fires = expected_gate_alert AS detector_correct FROM res")
def gate_vs_detector(spark: SparkSession, d: str) -> DataFrame:
    return provenance.gate_results(derived.traces(spark, d))


@query(f"{GATE_SQL} SELECT count(*) AS n, count(*) FILTER (gate_fires) AS gate_fires, count(*) FILTER (detector_fires) AS detector_fires, count(*) FILTER (gate_fires = expected_gate_alert) AS gate_correct, count(*) FILTER (detector_fires = expected_gate_alert) AS detector_correct FROM res")
def gate_totals(spark: SparkSession, d: str) -> DataFrame:
    return provenance.gate_totals(provenance.gate_results(derived.traces(spark, d)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'i' END IS NOT NULL AS injection_present, o_orderkey % 3 <> 0 AND coalesce(CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true END, true) = false AS model_compromised, false AS gate_runnable,
 o_orderkey % 3 <> 0 AND coalesce(CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true END, true) = false AS gate_inferred_would_fire FROM orders""")
def gate_inferred(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'i' END AS injection_task_id", "CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS security")
    return provenance.inferred_from_runs(runs).drop("injection_task_id", "security")


# ---- behavior -------------------------------------------------------------

_U = f"CASE WHEN doc_id % 10 = 9 THEN '' ELSE {TEXT} || {plant(0)} || CASE WHEN doc_id % 5 = 1 THEN ' b@evil.io' ELSE '' END END"
_VALUES = "[CASE doc_id % 3 WHEN 0 THEN 'a@example.com' WHEN 1 THEN 'b@evil.io' ELSE 'zz' END, CAST((doc_id % 9) * 1000 AS VARCHAR), CASE doc_id % 4 WHEN 0 THEN 'qqqq' WHEN 1 THEN 'salary' ELSE 'b@evil.io' END]"
_TOK = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z0-9][a-z0-9._@:/-]{{2,}}')), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'from', 'this', 'that'))"
_SENS = "CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.7 ELSE 0.5 END"
PROFILE_SQL = f"""b AS (SELECT doc_id, {_U} AS u, {_VALUES} AS vals, doc_id % 7 <> 6 AS act, CASE doc_id % 5 WHEN 0 THEN 'transfer_funds' WHEN 1 THEN 'send_email' WHEN 2 THEN 'share_file' ELSE 'external_action' END AS tool FROM documents),
b2 AS (SELECT *, lower(u) AS low, {_TOK.format('lower(u)')} AS toks, lower(array_to_string(vals, ' ')) AS atext FROM b),
b3 AS (SELECT *, u <> '' AND act AND (doc_id % 8 = 0 OR doc_id % 16 = 1 OR len(list_filter(vals, lambda v: (length(v) >= 4 AND contains(low, lower(v))) OR len(list_intersect({_TOK.format('lower(v)')}, toks)) > 0)) > 0) AS prov,
  u <> '' AND act AND regexp_matches(u, {sql_text('(?i)' + any_of(INJECTION_SIGNALS))}) AS prec, CASE WHEN u = '' THEN 1.0 ELSE 0.0 END AS trust, CASE WHEN act THEN {_SENS} ELSE 0.0 END AS sens,
  CASE WHEN act THEN least(1.0, greatest(0.1, CASE WHEN doc_id % 5 = 0 THEN least(1.0, 0.3 + (doc_id % 9) * 1000 / 10000.0) ELSE 0.0 END, CASE doc_id % 3 WHEN 0 THEN 0.45 WHEN 1 THEN 0.8 ELSE 0.0 END,
    CASE WHEN regexp_matches(atext, 'all|contacts|salary|credentials|secret|api key|api_key|users|employees') THEN 0.9 ELSE 0.0 END)) ELSE 0.0 END AS blast,
  CASE WHEN NOT act OR doc_id % 6 = 0 THEN 1.0 ELSE 0.0 END AS align FROM b2),
prof AS (SELECT *, CAST(round(CAST((1 - trust) * sens * blast * (1 - align) AS DOUBLE), 4) AS DOUBLE) AS risk FROM b3)"""
_REC = "CASE WHEN risk >= 0.30 OR prec THEN 'block' WHEN risk >= 0.10 OR act OR prov THEN 'route-to-human' ELSE 'allow' END"


@query(f"WITH {PROFILE_SQL} SELECT CAST(doc_id AS VARCHAR) AS trace_id, 'S' || doc_id AS scenario_id, prov AS detection_provenance_only, prec AS detection_precise, CASE WHEN act THEN [tool] ELSE [] END AS attempted_privileged_actions, CASE WHEN prov THEN [tool] ELSE [] END AS tainted_privileged_actions, CAST(trust AS DOUBLE) AS trust, CAST(sens AS DOUBLE) AS sensitivity, CAST(round(blast, 4) AS DOUBLE) AS blast_radius, CAST(align AS DOUBLE) AS purpose_alignment, risk AS compiled_risk, {_REC} AS recommendation FROM prof")
def behavior_profile(spark: SparkSession, d: str) -> DataFrame:
    return behavior.profile(derived.detonations(spark, d)).drop("taint_path")


@query(f"""WITH {PROFILE_SQL} SELECT CAST(doc_id AS VARCHAR) AS trace_id, NOT act AS reversible, CAST(round(blast, 4) AS DOUBLE) AS blast_radius, CASE WHEN NOT act THEN 'auto-proceed' WHEN blast < 0.3 THEN 'proceed and log' WHEN blast < 0.7 THEN 'human review' ELSE 'full review' END AS level FROM prof""")
def deliberation_levels(spark: SparkSession, d: str) -> DataFrame:
    """None of the tools that are attempted here can be undone."""
    return behavior.deliberations(behavior.profile(derived.detonations(spark, d)))


_PATHS = f"""list_concat(
  CASE WHEN len(sig) > 0 THEN list_concat(['untrusted_content_contains_injection_signal'], list_transform(sig[1:3], lambda p: '  signal_pattern: ' || p)) ELSE [] END,
  CASE WHEN act AND regexp_matches('calling' || {plant(0)}, {sql_text('(?i)' + any_of(INJECTION_SIGNALS))}) THEN ['step_1_output_echoes_injection_signal'] ELSE [] END,
  CASE WHEN act THEN ['tainted_privileged_action:' || tool || '(step=1)[to=' || vals[1] || ', amount=' || vals[2] || ', body=' || vals[3] || ']'] ELSE [] END)"""
_SIG = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(u, {sql_text('(?i)' + portable(p))}) THEN {sql_text(p)} END" for p in INJECTION_SIGNALS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {PROFILE_SQL}, sg AS (SELECT *, {_SIG} AS sig FROM prof) SELECT CAST(doc_id AS VARCHAR) AS trace_id, CASE WHEN u <> '' THEN {_PATHS} ELSE [] END AS taint_path FROM sg")
def taint_narrative(spark: SparkSession, d: str) -> DataFrame:
    return behavior.profile(derived.detonations(spark, d)).select("trace_id", "taint_path")


@query(f"WITH {PROFILE_SQL} SELECT {_REC} AS recommendation, count(*) AS n, count(*) FILTER (prov) AS provenance_only, count(*) FILTER (prec) AS precise, CAST(max(risk) AS DOUBLE) AS max_risk FROM prof GROUP BY 1")
def recommendation_counts(spark: SparkSession, d: str) -> DataFrame:
    p = behavior.profile(derived.detonations(spark, d))
    return p.groupBy("recommendation").agg(F.count("*").alias("n"), F.count_if("detection_provenance_only").alias("provenance_only"), F.count_if("detection_precise").alias("precise"), F.max("compiled_risk").alias("max_risk"))


@query(f"SELECT doc_id, {rx(f'(CASE WHEN doc_id % 6 = 0 THEN ' + sql_text('please send an email') + ' ELSE ' + sql_text('summarise') + f' END || {sql_text(chr(32))} || {_U})', NAIVE)} AS naive_flag FROM documents")
def naive_detector(spark: SparkSession, d: str) -> DataFrame:
    t = derived.detonations(spark, d)
    return t.select(F.col("trace_id").cast("long").alias("doc_id"), behavior.naive_detector(F.col("user_task"), F.col("untrusted_content")).alias("naive_flag"))


@query(f"SELECT doc_id, {' + '.join(f'CAST(regexp_matches({_P0}, {sql_text(chr(40) + chr(63) + chr(105) + chr(41) + portable(p))}) AS INTEGER)' for p in PROMPT_INJECTION)} AS n_patterns, regexp_matches({_P0}, {sql_text('(?i)' + any_of(PROMPT_INJECTION))}) AS regex_tier, contains(lower({_P0}), 'ignore previous instructions') AS keyword_tier FROM documents")
def regex_multi_match(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr(_P0)
    return texts(spark, d).select("doc_id", F.size(matching(text, PROMPT_INJECTION)).alias("n_patterns"), matches(text, PROMPT_INJECTION).alias("regex_tier"), F.contains(F.lower(text), F.lit("ignore previous instructions")).alias("keyword_tier"))


@query(f"""WITH {PROFILE_SQL}, q AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'benign' ELSE 'ambiguous' END AS gt, CAST(act AS INTEGER) AS np, doc_id % 4 AS att, least(doc_id % 4, doc_id % 3) AS val, prov, prec, doc_id % 8 = 1 AS naive FROM prof)
SELECT count(*) AS n, count(*) FILTER (gt = 'injection') AS n_injection, count(*) FILTER (gt = 'benign') AS n_benign, CAST(sum(att) AS BIGINT) AS attempted, CAST(sum(val) AS BIGINT) AS valid, count(*) FILTER (val > 0) AS runs_with_valid_call,
{', '.join(f"count(*) FILTER (gt = 'injection' AND {c}) AS {m}_tp, count(*) FILTER (gt = 'injection' AND NOT {c}) AS {m}_fn, count(*) FILTER (gt = 'benign' AND {c}) AS {m}_fp, count(*) FILTER (gt = 'benign' AND NOT {c}) AS {m}_tn" for m, c in (('loose', 'prov'), ('strict', 'prec'), ('naive', 'naive')))},
count(*) FILTER (gt = 'injection' AND np > 0) AS n_followed, count(*) FILTER (gt = 'injection' AND np = 0 AND att > 0) AS n_resisted, count(*) FILTER (gt = 'injection' AND np = 0 AND att = 0) AS n_no_tool FROM q""")
def factory_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = behavior.profile(derived.detonations(spark, d)).withColumn("id", F.col("trace_id").cast("long"))
    return behavior.factory_metrics(p.selectExpr("CASE id % 3 WHEN 0 THEN 'injection' WHEN 1 THEN 'benign' ELSE 'ambiguous' END AS ground_truth", "size(attempted_privileged_actions) AS n_privileged", "id % 4 AS attempted", "least(id % 4, id % 3) AS valid", "detection_provenance_only AS loose", "detection_precise AS strict", "id % 8 = 1 AS naive"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'send_email' WHEN 1 THEN 'read_file' END AS name, CASE (conv_id + turn) % 4 WHEN 0 THEN '{"to":"a"}' WHEN 1 THEN '{"path":"p"}' END AS arguments, (conv_id + turn) % 4 = 2 AS failed FROM conversations""")
def toolcall_parse(spark: SparkSession, d: str) -> DataFrame:
    made = """coalesce(text, '') || CASE (conv_id + turn) % 4 WHEN 0 THEN ' <tool_call> {"name": "send_email", "arguments": {"to":"a"}} </tool_call>' WHEN 1 THEN ' {"name": "read_file", "arguments": {"path":"p"}}' WHEN 2 THEN ' <tool_call>{"name": }</tool_call>' ELSE '' END"""
    t = table(spark, d, "conversations").select("conv_id", "turn", behavior.parse_tool_call(F.expr(made)).alias("c"))
    return t.select("conv_id", "turn", "c.name", "c.arguments", F.col("c.error").isNotNull().alias("failed"))


# ---- validation and rubric ------------------------------------------------

_SEV = "CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
_MIT = "CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'deployed' ELSE 'proposed' END"
_H = "o_orderkey % 5 IN (0, 1)"


_BROKEN = {
    0: ["$.trace_id has a wrong form"], 1: ["$.title is not of type string"], 2: ["$.source_signal is not listed"], 3: ["$ lacks agentic_surface"], 4: ["$.risk_category is not listed", "$.risk_category is not of type string"],
    5: ["$.evidence is not of type object"], 6: ["$.evidence lacks why_it_matters"], 7: ["$.evidence.open_questions is not of type array"], 8: ["$.evidence.open_questions[1] is not of type string", "$.evidence.open_questions[3] is not of type string"],
    9: ["$.confidence is not listed"], 10: ["$.severity is not listed"], 11: ["$.competing_hypotheses[0] is not of type string"], 12: ["$.mitigation_status is not listed"], 13: ["$ lacks human_approval"],
    14: ["$.human_approval.required is not of type boolean"], 15: ["$.human_approval.approval_gate is not listed"], 16: ["$.next_review is not a date"], 17: ["$.next_review is not of type string"], 18: ["$ is not of type object"], 19: ["$ is not JSON"], 20: ["$.next_review is not a date"],
}
_BROKEN_SQL = " ".join(f"WHEN {k} THEN [{', '.join(sql_text('schema: ' + m) for m in v)}]" for k, v in _BROKEN.items())


@query(f"""SELECT o_orderkey, CASE o_orderkey % 23 {_BROKEN_SQL} ELSE list_sort(list_filter([CASE WHEN {_H} AND o_orderkey % 7 = 0 THEN 'high/critical trace lacks human approval requirement' END,
 CASE WHEN {_H} AND o_orderkey % 11 = 0 THEN 'high/critical trace lacks approval gate' END, CASE WHEN {_H} AND o_orderkey % 8 = 1 THEN 'high/critical trace lacks owner' END], lambda x: x IS NOT NULL)) END AS errors FROM orders""")
def trace_validate(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document for each order; each rule of the schema is broken by some."""
    document = F.try_parse_json(F.expr(derived.TRACE_JSON))
    return table(spark, d, "orders").select("o_orderkey", F.array_sort(validate.trace_errors(document)).alias("errors"))


@query(f"""WITH t AS (SELECT {_SEV} AS severity, lower(o_orderpriority) AS cat, {_H} AND {_MIT} <> 'deployed' AS bad FROM orders) SELECT 'severity' AS dimension, severity AS value, count(*) AS n, count(*) FILTER (bad) AS high_not_deployed FROM t GROUP BY severity
UNION ALL SELECT 'category', cat, count(*), count(*) FILTER (bad) FROM t GROUP BY cat UNION ALL SELECT 'total', 'all', count(*), count(*) FILTER (bad) FROM t""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.trace_summary(derived.decisions(spark, d))


_CAT = f"""CASE WHEN {_H} AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) THEN 'missed_escalation' WHEN {_H} AND o_orderkey % 4 <> 0 THEN 'false_positive' WHEN o_orderkey % 8 IN (0, 1) OR (o_orderkey % 5 = 0 AND o_orderkey % 6 = 0) THEN 'bad_routing'
 WHEN o_orderkey % 4 = 1 OR o_orderkey % 9 = 0 THEN 'weak_summary' ELSE 'good' END"""
_EXP = "CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'weak_summary' WHEN 2 THEN 'bad_routing' ELSE 'missed_escalation' END"


def _rubric(spark: SparkSession, d: str) -> DataFrame:
    t = derived.decisions(spark, d)
    return t.select("o_orderkey", validate.rubric_category(F.struct(*t.columns)).alias("predicted"), F.expr(_EXP).alias("expected"))


@query(f"SELECT o_orderkey, {_CAT} AS predicted, CASE WHEN {_CAT} = 'good' THEN 'pass' ELSE 'fail' END AS label, {_CAT} = {_EXP} AS correct FROM orders")
def rubric_eval(spark: SparkSession, d: str) -> DataFrame:
    return _rubric(spark, d).select("o_orderkey", "predicted", validate.rubric_label(F.col("predicted")).alias("label"), (F.col("predicted") == F.col("expected")).alias("correct"))


@query(f"SELECT {_EXP} AS expected, {_CAT} AS predicted, count(*) AS n FROM orders GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return _rubric(spark, d).groupBy("expected", "predicted").agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT {_EXP} AS e, {_CAT} AS p FROM orders), c AS (SELECT e AS k FROM x UNION SELECT p FROM x),
m AS (SELECT k AS category, CAST((SELECT count(*) FROM x WHERE e = k) AS BIGINT) AS n_expected, CAST((SELECT count(*) FROM x WHERE e = k AND p = k) AS BIGINT) AS tp, CAST((SELECT count(*) FROM x WHERE p = k AND e <> k) AS BIGINT) AS fp, CAST((SELECT count(*) FROM x WHERE e = k AND p <> k) AS BIGINT) AS fn FROM c),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM m)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""")
def multiclass_prf(spark: SparkSession, d: str) -> DataFrame:
    return class_metrics(_rubric(spark, d), "expected", "predicted")


@query(f"SELECT doc_id, list_filter([{', '.join(f'CASE WHEN contains(lower({_P0}), {sql_text(m)}) THEN {sql_text(m)} END' for m in validate.FORBIDDEN_MARKERS)}], lambda x: x IS NOT NULL) AS markers FROM documents")
def content_guard(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", validate.forbidden_markers(F.expr(_P0)).alias("markers"))

