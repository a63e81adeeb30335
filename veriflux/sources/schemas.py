"""Schemas of the records the engine reads."""

APPROVAL = "STRUCT<required: BOOLEAN, received: BOOLEAN>"
TELEMETRY = "STRUCT<tool_choice_entropy: DOUBLE, top_choice_margin: DOUBLE, sample_disagreement: DOUBLE>"
CONTEXT = "ARRAY<STRUCT<source: STRING, trust: STRING, content: STRING>>"

TRACE = """trace_id STRING, title STRING, source_signal STRING, agentic_surface STRING, risk_category STRING,
 evidence STRUCT<observed_behavior: STRING, why_it_matters: STRING, open_questions: ARRAY<STRING>>,
 confidence STRING, severity STRING, competing_hypotheses ARRAY<STRING>, recommended_action STRING, owner STRING,
 mitigation_status STRING, human_approval STRUCT<required: BOOLEAN, reason: STRING, approval_gate: STRING>,
 residual_risk STRING, reusable_eval_case STRING, taxonomy_gap STRING, next_review STRING"""

RUN = f"""run_id STRING, model STRING, task STRING,
 permissions STRUCT<connectors: ARRAY<STRING>, allowed_tools: ARRAY<STRING>, sensitive_actions: ARRAY<STRING>>,
 ingress STRUCT<user_prompt: STRING, retrieved_context: {CONTEXT}>,
 trajectory ARRAY<STRUCT<step: INT, type: STRING, content: STRING, tool: STRING, connector: STRING, args: STRING,
   external_side_effect: BOOLEAN, approval: {APPROVAL}, telemetry: {TELEMETRY}>>,
 drafts ARRAY<STRUCT<stage: STRING, content: STRING>>, final STRUCT<content: STRING, destination: STRING>"""

SESSION = f"""session_id STRING, model STRING, user_prompt STRING, retrieved_context {CONTEXT},
 tool_calls ARRAY<STRUCT<tool: STRING, connector: STRING, args: STRING, external_side_effect: BOOLEAN, approval: {APPROVAL}>>,
 telemetry {TELEMETRY}, model_output STRING"""

NODE = """node_id STRING, mode STRING, patch_channel STRING,
 privacy STRUCT<source_auditable: BOOLEAN, raw_upload_enabled: BOOLEAN, aggregate_only: BOOLEAN, private_data_leaves_device: BOOLEAN>,
 events ARRAY<STRUCT<event_id: STRING, category: STRING, signature_hit: BOOLEAN, entropy: DOUBLE, top_choice_margin: DOUBLE,
   sample_disagreement: DOUBLE, model_disagreement: DOUBLE, external_side_effect: BOOLEAN, red_team_generated: BOOLEAN,
   patch_version: STRING, contains_raw_content: BOOLEAN, contains_private_data: BOOLEAN>>"""

STEP_GRAPH = """trace_id STRING, scenario STRING, expected_gate_alert BOOLEAN, expected_rationale STRING,
 steps ARRAY<STRUCT<step_id: STRING, source: STRING, type: STRING, content: STRING, tool: STRING, privileged: BOOLEAN,
   args: STRING, derived_from: ARRAY<STRING>, approves: ARRAY<STRING>>>"""

SCENARIO = """id STRING, ground_truth STRING, user_task STRING, untrusted_content STRING, untrusted_source STRING,
 available_tools ARRAY<STRING>, description STRING"""

DETONATION = """trace_id STRING, scenario_id STRING, model STRING, user_task STRING, untrusted_content STRING, untrusted_source STRING,
 available_tools ARRAY<STRING>,
 steps ARRAY<STRUCT<step: INT, model_output: STRING, tool: STRING, arguments: MAP<STRING, STRING>, is_privileged_attempt: BOOLEAN,
   derived_from: ARRAY<STRING>, tainted: BOOLEAN>>,
 privileged_actions_attempted ARRAY<STRUCT<step: INT, tool: STRING, arguments: MAP<STRING, STRING>, derived_from: ARRAY<STRING>, tainted: BOOLEAN>>,
 valid_tool_calls_total INT, attempted_tool_calls_total INT, total_steps_run INT, runtime_seconds DOUBLE"""

OUTCOME = """injecagent_id STRING, split STRING, attack_type STRING, attacker_goal STRING, attacker_tools_mapped ARRAY<STRING>,
 engaged BOOLEAN, followed BOOLEAN, provenance_only_caught BOOLEAN, precise_caught BOOLEAN, behavioral_caught BOOLEAN,
 naive_caught BOOLEAN, compiled_risk DOUBLE, recommendation STRING, attempted_privileged_actions ARRAY<STRING>,
 runtime_seconds DOUBLE, trace_id STRING, model STRING, total_steps INT, valid_tool_calls INT, attempted_tool_calls INT, error STRING"""

CASE = """`User Instruction` STRING, `User Tool` STRING, `Tool Response` STRING, `Attacker Instruction` STRING,
 `Attacker Tools` ARRAY<STRING>, `Attack Type` STRING, `Expected Achievements` STRING"""

BENCH_RUN = """suite_name STRING, pipeline_name STRING, user_task_id STRING, injection_task_id STRING, attack_type STRING,
 utility BOOLEAN, security BOOLEAN, error STRING, duration DOUBLE, turn_count INT"""

SIGNAL = """signal_id STRING, title STRING, source_tier INT, source_type STRING, source_name STRING, source_url STRING,
 observed_at STRING, summary STRING, risk_hypothesis STRING, affected_surfaces ARRAY<STRING>, risk_categories ARRAY<STRING>,
 evidence_status STRING, novelty INT, actionability INT, source_reliability INT, raw_detail_policy STRING,
 proposed_probe STRUCT<probe_id: STRING, description: STRING, expected_detection_stage: STRING, safe_reproduction: STRING>, notes STRING"""

DELTA = "delta_id STRING, name STRING, surfaces ARRAY<STRING>, new_authorities ARRAY<STRING>, description STRING"
RISK = "risk_id STRING, name STRING, surfaces ARRAY<STRING>, known_evidence ARRAY<STRING>"
HYPOTHESIS = """risk_id STRING, title STRING, thesis STRING, likelihood INT, impact INT, novelty INT, actionability INT, confidence STRING,
 affected_surfaces ARRAY<STRING>, why_might_be_under_instrumented STRING, likely_failure_path STRING, early_indicators ARRAY<STRING>,
 safe_probe STRING, decision_needed STRING, sources ARRAY<STRUCT<label: STRING, url: STRING>>"""
RULE = """signature_id STRING, name STRING, target STRING, category STRING, severity STRING, patterns ARRAY<STRING>, requires_external_side_effect BOOLEAN, requires_missing_approval BOOLEAN, sensitive_terms ARRAY<STRING>,
 thresholds STRUCT<tool_choice_entropy_min: DOUBLE, top_choice_margin_max: DOUBLE, sample_disagreement_min: DOUBLE>, recommended_action STRING"""
MONITOR_EVENT = "session_id STRING, model STRING, signature_id STRING, signature_name STRING, category STRING, severity STRING, stage STRING, match STRING, evidence_excerpt STRING, evidence_hash STRING, recommended_action STRING"
QUERY_CONFIG = "name STRING, query STRING, affected_surfaces ARRAY<STRING>, risk_categories ARRAY<STRING>, proposed_probe_stage STRING"
PATCH_CASE = """case_id STRING, title STRING, caveat STRING, source_signal STRUCT<source_type: STRING, source_confidence: STRING, raw_detail_policy: STRING, summary: STRING>,
 risk_delta_cell STRUCT<capability_delta: STRING, risk_class: STRING, shared_surfaces: ARRAY<STRING>, why_it_matters: STRING>, safe_probe STRUCT<probe_id: STRING, description: STRING, safety_controls: ARRAY<STRING>>,
 observable_run_summary STRUCT<target_task: STRING, observed_failure_mode: STRING, first_useful_intervention: STRING, affected_controls: ARRAY<STRING>>, sentinel_event STRUCT<stage: STRING, category: STRING, severity: STRING, signal: STRING, recommended_action: STRING>,
 decision_trace_summary STRUCT<owner: STRING, decision_needed: STRING, residual_risk: STRING>, patch_object STRUCT<type: STRING, description: STRING, verification: STRING, rollout_note: STRING>, residual_monitor STRUCT<monitor_id: STRING, metrics: ARRAY<STRING>, reopen_trigger: STRING>"""
LABELLED = "text STRING, label INT, split STRING"
EVAL_CASE = f"id STRING, category STRING, expected_label STRING, expected_failure_category STRING, rationale STRING, input_trace STRUCT<{TRACE}>"
REGISTER = "risk_id STRING, title STRING, surface STRING, category STRING, severity STRING, likelihood STRING, owner STRING, status STRING, mitigation STRING, residual_risk STRING, approval_gate STRING, next_review STRING, notes STRING"

# The JSON Schema of a decision trace.
_TEXT = {"type": "string"}
_TEXTS = {"type": "array", "items": _TEXT}
TRACE_SCHEMA = {
    "type": "object",
    "required": ["trace_id", "title", "source_signal", "agentic_surface", "risk_category", "evidence", "confidence", "severity", "recommended_action", "owner", "mitigation_status", "human_approval", "residual_risk", "next_review"],
    "properties": {
        "trace_id": {"type": "string", "pattern": "^ART-(R[0-9]{2}|[0-9]{3})$"},
        "title": _TEXT,
        "source_signal": {"type": "string", "enum": ["investigation", "eval", "red_team", "security_review", "product_launch", "external_research", "incident", "user_report", "synthetic_probe"]},
        "agentic_surface": {"type": "string", "enum": ["browser", "connector", "tool_calling", "memory", "retrieval", "computer_use", "multi_agent", "workflow_automation"]},
        "risk_category": {"type": "string", "enum": ["prompt_injection", "connector_data_boundary", "tool_overreach", "social_engineering", "policy_evasion", "memory_retrieval_contamination", "sensitive_action_confirmation", "cyber_adjacent_abuse"]},
        "evidence": {"type": "object", "required": ["observed_behavior", "why_it_matters", "open_questions"], "properties": {"observed_behavior": _TEXT, "why_it_matters": _TEXT, "open_questions": _TEXTS}},
        "confidence": {"type": "string", "enum": ["low", "medium", "high"]},
        "severity": {"type": "string", "enum": ["low", "medium", "high", "critical"]},
        "competing_hypotheses": _TEXTS,
        "recommended_action": _TEXT,
        "owner": _TEXT,
        "mitigation_status": {"type": "string", "enum": ["none", "proposed", "in_progress", "deployed", "needs_review"]},
        "human_approval": {
            "type": "object", "required": ["required", "reason", "approval_gate"],
            "properties": {"required": {"type": "boolean"}, "reason": _TEXT, "approval_gate": {"type": "string", "enum": ["none", "before_external_side_effect", "before_sensitive_data_access", "before_cross_connector_action", "before_high_risk_advice", "before_policy_exception"]}},
        },
        "residual_risk": _TEXT,
        "reusable_eval_case": _TEXT,
        "taxonomy_gap": _TEXT,
        "next_review": {"type": "string", "format": "date"},
    },
}
# End of fixed values.
