"""Queries over what the other modules leave: free-form JSON, prompts, splits, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_values
from ..functions.metrics import binary_metrics
from ..operators import behavior, corpus, operating, validate
from ..operators.network import RAW_FIELD_NAMES
from . import derived
from .registry import query, sql_text, table, texts

NESTED = """CASE WHEN event_id % 31 = 0 THEN '{"a": [{"raw_prompt": "x"}, {"b": {"raw_file": true}}]}' ELSE props END"""


@query("""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN ['x', 'True'] ELSE [props->>'k'] END AS scalars, CASE WHEN event_id % 31 = 0 THEN ['x'] ELSE [] END AS strings FROM events""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", json_values.values(F.expr(NESTED)).alias("scalars"), json_values.values(F.expr(NESTED), False).alias("strings"))


@query("SELECT event_id, CASE WHEN event_id % 31 = 0 THEN ['$.a[0].raw_prompt', '$.a[1].b.raw_file'] ELSE [] END AS paths FROM events")
def raw_field_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", json_values.key_paths(F.expr(NESTED), RAW_FIELD_NAMES).alias("paths"))


_TASK = "CASE WHEN doc_id % 6 = 0 THEN 'please send an email' ELSE 'summarise' END"
_SHOWN = "CASE WHEN doc_id % 4 <> 0 THEN coalesce(text, '') END"


@query(f"""SELECT doc_id, sha256(CASE WHEN doc_id % 4 = 0 THEN {_TASK} ELSE {_TASK} || chr(10) || chr(10) || '--- Content retrieved from ' || coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, 'external source') || ' ---' || chr(10) || coalesce(text, '') || chr(10) || '--- End of retrieved content ---' END) AS message_sha FROM documents""")
def user_messages(spark: SparkSession, d: str) -> DataFrame:
    message = behavior.user_message(F.expr(_TASK), F.expr("CASE WHEN doc_id % 5 <> 0 THEN source END"), F.expr(_SHOWN))
    return texts(spark, d).select("doc_id", F.sha2(message, 256).alias("message_sha"))


_LINES = ", ".join(f"CASE WHEN list_contains(tools, '{t}') THEN {sql_text('  ' + t + '(' + ', '.join(r + m) + ')' + (' [PRIVILEGED]' if t in behavior.PRIVILEGED else '') + ': ' + text)} END" for t, (r, m, text) in behavior.TOOLS.items())


@query(f"""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['send_email', 'http_get', 'odd'] WHEN 1 THEN ['share_file', 'write_file'] ELSE ['db_query', 'read_file', 'transfer_funds'] END AS tools FROM part)
SELECT p_partkey, {sql_text(behavior.PROMPT_HEAD)} || '<tool_call>' || CASE p_partkey % 3 WHEN 0 THEN '{{"name": "http_get", "arguments": {{"url": "https://api.example.com/data"}}}}' WHEN 1 THEN '{{"name": "share_file", "arguments": {{"key": "value"}}}}' ELSE '{{"name": "read_file", "arguments": {{"path": "report.txt"}}}}' END || '</tool_call>'
 || chr(10) || chr(10) || 'Available tools:' || chr(10) || array_to_string(list_filter([{_LINES}], lambda x: x IS NOT NULL), chr(10)) || {sql_text(behavior.PROMPT_TAIL)} AS prompt FROM p""")
def system_prompts(spark: SparkSession, d: str) -> DataFrame:
    tools = "CASE p_partkey % 3 WHEN 0 THEN array('send_email', 'http_get', 'odd') WHEN 1 THEN array('share_file', 'write_file') ELSE array('db_query', 'read_file', 'transfer_funds') END"
    return table(spark, d, "part").select("p_partkey", behavior.system_prompt(F.expr(tools)).alias("prompt"))


@query("""WITH o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (conv_id + turn) % 4 AS m FROM conversations),
s AS (SELECT conv_id, min(k) FILTER (m >= 2 AND k <= 3) AS stop, least(3, count(*)) AS n FROM o GROUP BY conv_id)
SELECT s.conv_id AS scenario_id, CAST(count(*) AS INTEGER) AS total_steps_run, CAST(count(*) FILTER (m < 2) AS INTEGER) AS attempted_tool_calls_total, CAST(count(*) FILTER (m = 1) AS INTEGER) AS valid_tool_calls_total, CAST(count(*) FILTER (m = 0) AS INTEGER) AS n_privileged,
 CAST(count(*) FILTER (m = 2) AS INTEGER) AS n_errors FROM s JOIN o ON o.conv_id = s.conv_id AND o.k <= coalesce(s.stop, s.n) GROUP BY s.conv_id""")
def detonation_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as the stored outputs of a tool loop."""
    made = """coalesce(text, '') || CASE (conv_id + turn) % 4 WHEN 0 THEN ' <tool_call> {"name": "send_email", "arguments": {"to":"a"}} </tool_call>' WHEN 1 THEN ' {"name": "read_file", "arguments": {"path":"p"}}' WHEN 2 THEN ' <tool_call>{"name": }</tool_call>' ELSE '' END"""
    turns = table(spark, d, "conversations")
    outputs = turns.select(F.col("conv_id").alias("scenario_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("step"), F.expr(made).alias("model_output"))
    t = behavior.replay(turns.select(F.col("conv_id").alias("scenario_id")).distinct(), outputs)
    return t.select("scenario_id", "total_steps_run", "attempted_tool_calls_total", "valid_tool_calls_total", F.size("privileged_actions_attempted").alias("n_privileged"), F.size(F.filter("steps", lambda s: s["parse_error"].isNotNull())).alias("n_errors"))


@query("SELECT lang AS split, source AS attack_type, count(*) AS n FROM documents GROUP BY 1, 2")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("split"), F.col("source").alias("attack_type"))
    return docs.groupBy("split", "attack_type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT d.lang, length(d.text) % 3 = 0 AS pred, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT lang, count(*) FILTER (pred AND label = 1) / nullif(count(*) FILTER (label = 1), 0) AS recall FROM p GROUP BY lang)
SELECT a.lang AS train, b.lang AS test, a.recall - b.recall AS gap FROM r a JOIN r b ON a.lang <> b.lang WHERE a.recall IS NOT NULL AND b.recall IS NOT NULL""")
def generalisation_gaps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.length("text") % 3 == 0).alias("pred"))
    m = binary_metrics(docs.join(table(spark, d, "labels"), "doc_id"), F.col("pred"), F.col("toxic"), "lang").where(~F.isnan("recall")).select("lang", "recall")
    other = m.select(F.col("lang").alias("test"), F.col("recall").alias("there"))
    return m.join(other, F.col("lang") != F.col("test")).select(F.col("lang").alias("train"), "test", (F.col("recall") - F.col("there")).alias("gap"))


_SEV = "CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"


@query(f"""SELECT o_orderkey, {_SEV} AS before, CASE WHEN o_orderkey % 7 = 0 AND {_SEV} IN ('high', 'critical') THEN 'medium' ELSE {_SEV} END AS after, o_orderkey % 7 = 0 AND {_SEV} IN ('high', 'critical') AS changed FROM orders""")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    t = derived.decisions(spark, d)
    after = F.when(~F.col("human_approval.required") & validate.high(F.col("severity")), "medium").otherwise(F.col("severity"))
    return t.select("o_orderkey", F.col("severity").alias("before"), after.alias("after")).withColumn("changed", F.col("before") != F.col("after"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE p_brand END AS label, CASE WHEN contains(upper(p_name || ' 7b'), '7B') THEN '7B' ELSE 'unknown' END AS params FROM part")
def scenario_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.coalesce(F.expr("CASE WHEN p_partkey % 4 <> 0 THEN p_brand END"), F.lit("unknown")).alias("label"), corpus.param_label(F.concat("p_name", F.lit(" 7b"))).alias("params"))


_DAY = "CAST(o_orderdate AS DATE)"
_RISK_SQL = f"""risk AS (SELECT o_orderpriority, 'c' || o_orderkey % 60 AS cell, o_orderkey % 8 NOT IN (0, 1) AS owned, o_orderkey % 3 <> 0 AS evidenced, {_DAY} AS created, CASE WHEN o_orderkey % 5 <> 0 THEN {_DAY} + CAST(o_orderkey % 40 AS INTEGER) END AS decided, o_orderstatus = 'F' AS closed, o_orderkey % 13 = 0 AS reopened,
 CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END IN ('high', 'critical') AS high, CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'deployed' WHEN 2 THEN 'none' ELSE 'proposed' END AS mitigation_status, {_DAY} + CAST(o_orderkey % 90 AS INTEGER) AS next_review, CASE WHEN o_orderkey % 7 <> 0 THEN {_DAY} + CAST(o_orderkey % 100 AS INTEGER) END AS reviewed,
 CASE WHEN o_orderkey % 4 = 0 THEN {_DAY} - CAST(o_orderkey % 30 AS INTEGER) END AS first_signal FROM orders)"""


def _risks(spark: SparkSession, d: str) -> DataFrame:
    """One risk record for each order."""
    day = "cast(o_orderdate as date)"
    return table(spark, d, "orders").selectExpr(
        "o_orderpriority", "concat('c', o_orderkey % 60) AS cell", "CASE o_orderkey % 8 WHEN 0 THEN ' ' ELSE 'ana' END AS owner", "o_orderkey % 8 <> 1 AS acknowledged", "o_orderkey % 3 <> 0 AS evidenced", f"{day} AS created", f"CASE WHEN o_orderkey % 5 <> 0 THEN date_add({day}, cast(o_orderkey % 40 as int)) END AS decided",
        "o_orderstatus = 'F' AS closed", "o_orderkey % 13 = 0 AS reopened", "CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity", "CASE o_orderkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'deployed' WHEN 2 THEN null ELSE 'proposed' END AS mitigation_status",
        f"date_add({day}, cast(o_orderkey % 90 as int)) AS next_review", f"CASE WHEN o_orderkey % 7 <> 0 THEN date_add({day}, cast(o_orderkey % 100 as int)) END AS reviewed", f"CASE WHEN o_orderkey % 4 = 0 THEN date_sub({day}, cast(o_orderkey % 30 as int)) END AS first_signal",
    )


@query(f"""WITH {_RISK_SQL} SELECT o_orderpriority, count(*) AS n_risks, count(DISTINCT CASE WHEN owned AND evidenced THEN cell END) / 64 AS coverage, count(*) FILTER (NOT closed AND owned) / nullif(count(*) FILTER (NOT closed), 0) AS ownership,
 CAST(quantile_cont(decided - created, 0.5) AS DOUBLE) AS median_latency, CAST(quantile_cont(decided - created, 0.9) AS DOUBLE) AS p90_latency, CAST(max(CASE WHEN NOT closed AND high THEN DATE '1998-08-02' - created END) AS INTEGER) AS oldest_open_high, count(*) FILTER (closed) / count(*) AS closure_rate, count(*) FILTER (closed AND reopened) / nullif(count(*) FILTER (closed), 0) AS reopen_rate,
 count(*) FILTER (high AND reviewed <= next_review) / nullif(count(*) FILTER (high), 0) AS freshness, CAST(quantile_cont(created - first_signal, 0.5) AS DOUBLE) AS median_lead, count(first_signal) AS n_dated_signals FROM risk GROUP BY o_orderpriority""")
def operating_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of risks by priority, at a fixed date."""
    return operating.risk_metrics(_risks(spark, d), 64, "1998-08-02", "o_orderpriority")


@query(f"WITH {_RISK_SQL} SELECT mitigation_status, count(*) AS n FROM risk WHERE NOT closed GROUP BY 1")
def mitigation_distribution(spark: SparkSession, d: str) -> DataFrame:
    return operating.mitigation_distribution(_risks(spark, d))


@query("""SELECT event_type, count(*) AS n_signals, count(*) FILTER (event_id % 9 <> 0 AND event_id % 6 <= 3) / count(*) AS triaged_in_time, count(*) FILTER (event_id % 2 = 0 AND event_id % 3 = 0) / nullif(count(*) FILTER (event_id % 2 = 0), 0) AS conversion, count(*) FILTER (event_id % 11 = 0) AS n_dismissed FROM events GROUP BY 1""")
def signal_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an intake signal."""
    s = table(spark, d, "events").selectExpr("event_type", "cast(ts as date) AS received", "CASE WHEN event_id % 9 <> 0 THEN date_add(cast(ts as date), cast(event_id % 6 as int)) END AS triaged", "event_id % 2 = 0 AS material", "event_id % 3 = 0 AS traced", "event_id % 11 = 0 AS dismissed")
    return operating.signal_conversion(s, 3, "event_type")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 50 AS cell, CAST(o_orderdate AS DATE) AS created FROM orders), s AS (SELECT DISTINCT user_id % 50 AS cell, CAST(ts AS DATE) - 9000 + CAST(event_id % 2500 AS INTEGER) AS received FROM events)
SELECT r.o_orderkey, s.received AS first_signal, CAST(r.created - s.received AS INTEGER) AS lead_days FROM r ASOF LEFT JOIN s ON r.cell = s.cell AND r.created >= s.received""")
def signal_lead_times(spark: SparkSession, d: str) -> DataFrame:
    """Orders as risk records, events as signals on the same cells: the nearest earlier signal of each."""
    risks = table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 50 AS cell", "cast(o_orderdate as date) AS created")
    signals = table(spark, d, "events").selectExpr("user_id % 50 AS cell", "date_add(date_sub(cast(ts as date), 9000), cast(event_id % 2500 as int)) AS received")
    return operating.with_first_signal(risks, signals).select("o_orderkey", "first_signal", F.datediff("created", "first_signal").alias("lead_days"))
