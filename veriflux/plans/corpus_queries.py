"""Queries over texts, pages, cases, outcomes and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import GOALS, LINEAGE_STOP, LINEAGE_TOKEN, RETRIEVED, TECHNIQUES, VECTORS, any_of, portable
from ..functions.text import clean, excerpt, lineage_tokens, stable_id, strip_tags, text_hash
from ..operators import behavior, corpus, intake, ontology, triage, validate
from . import derived
from .derived import OUTCOMES_SQL
from .registry import query, sql_text, table, texts

# ---- ontology -------------------------------------------------------------


def _ids(packs: dict[str, list[str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {sql_text(any_of(ps))}) THEN '{k}' END" for k, ps in packs.items()) + "], lambda x: x IS NOT NULL)"


AXES_SQL = f"""t0 AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
t1 AS (SELECT doc_id, low, {_ids(TECHNIQUES)} AS tq, {_ids(GOALS)} AS gl FROM t0),
ax AS (SELECT doc_id, [CASE WHEN regexp_matches(low, {sql_text(portable(RETRIEVED))}) THEN 'IT-02' ELSE 'IT-01' END] AS injection_type,
 list_concat(['DV-01'], list_filter([{', '.join(f"CASE WHEN regexp_matches(low, {sql_text(portable(p))}) THEN '{k}' END" for k, p in VECTORS.items())}], lambda x: x IS NOT NULL)) AS delivery_vector,
 CASE WHEN len(tq) > 0 THEN tq ELSE ['UNKNOWN'] END AS technique, CASE WHEN len(gl) > 0 THEN gl ELSE ['UNKNOWN'] END AS goal FROM t1)"""


#: The day that records without one are given.
DAY = "2024-01-01"


@query(f"WITH {AXES_SQL} SELECT * FROM ax")
def ontology_axes(spark: SparkSession, d: str) -> DataFrame:
    return ontology.classify(texts(spark, d), "doc_id")


DIST_SQL = "u AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, unnest({a}) AS node FROM ax" for a in ("injection_type", "delivery_vector", "technique", "goal")) + ")"


@query(f"WITH {AXES_SQL}, {DIST_SQL} SELECT axis, node, count(*) AS n, count(*) / (SELECT count(*) FROM ax) AS share FROM u GROUP BY axis, node")
def ontology_distribution(spark: SparkSession, d: str) -> DataFrame:
    return ontology.distribution(ontology.classify(texts(spark, d), "doc_id"))


@query(f"WITH {AXES_SQL} SELECT count(*) AS n, count(*) FILTER (len(technique) > 1) AS multi_technique, count(*) FILTER (technique = ['UNKNOWN']) AS no_technique FROM ax")
def multi_technique_rate(spark: SparkSession, d: str) -> DataFrame:
    return ontology.rates(ontology.classify(texts(spark, d), "doc_id"))


_TOP = "(SELECT node, count(*) AS n, min({'d': doc_id, 'i': i}) AS first FROM (SELECT doc_id, unnest(technique) AS node, generate_subscripts(technique, 1) AS i FROM ax) GROUP BY node ORDER BY n DESC, first LIMIT 3)"


@query(f"WITH {AXES_SQL} SELECT node, n, CASE node {' '.join(f'WHEN {sql_text(k)} THEN {sql_text(v)}' for k, v in ontology.TECHNIQUE_LABELS.items())} ELSE node END AS label FROM {_TOP}")
def topk_labels(spark: SparkSession, d: str) -> DataFrame:
    top = ontology.most_common(ontology.classify(texts(spark, d), "doc_id"), "technique", "doc_id", 3)
    return ontology.labelled(top).select("node", "n", "label")


_WALK = " ".join(f"WHEN {sql_text(n)} THEN {{'o': {sql_text(o) if o else 'NULL'}, 'a': {sql_text(a) if a else 'NULL'}, 'h': {sql_text(h) if h else 'NULL'}}}" for n, o, a, h in ontology.CROSSWALK)


@query(f"WITH {AXES_SQL}, {DIST_SQL}, c AS (SELECT axis, node, count(*) AS n FROM u GROUP BY axis, node), w AS (SELECT *, CASE node {_WALK} END AS x FROM c) SELECT axis, node, n, x.o AS owasp, x.a AS atlas, x.h AS hackaprompt, node IN ({', '.join(map(sql_text, ontology.EXTENSIONS))}) AS is_new FROM w")
def ontology_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Counts by node beside the ids of other frameworks."""
    return ontology.crosswalk(ontology.distribution(ontology.classify(texts(spark, d), "doc_id")).drop("share"))


# ---- text -----------------------------------------------------------------

WS = r"[\s\x{0B}\x{85}\x{A0}]+"


def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {sql_text(WS)}, ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_clean_sql('text')}) AS clean_sha, substr({_clean_sql('text')}, 1, 160) AS excerpt, substr(sha256(text), 1, 16) AS text_hash, 'DOC-' || upper(substr(sha1(source || '||' || lang), 1, 10)) AS stable_id FROM documents")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, d).select("doc_id", F.sha2(clean(t), 256).alias("clean_sha"), excerpt(t).alias("excerpt"), text_hash(t).alias("text_hash"), stable_id("DOC", F.col("source"), F.col("lang")).alias("stable_id"))


def _strip_sql(x: str) -> str:
    for p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        x = f"regexp_replace({x}, {sql_text(p)}, ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {sql_text(a)}, {sql_text(b)})"
    return _clean_sql(x)


@query(f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


_LI = r"(?is)<li[^>]*>(.*?)</li>"


_PAGE = "html || CASE page_id % 4 WHEN 0 THEN '<ul><li>No. Insights: fraud in case ' || page_id || ' ]</li><li>calm</li></ul>' WHEN 1 THEN '<p>Some harm was done. It was late! Was it a RISK? No risk, he said.</p>' ELSE '' END"
_ANY = lambda x, words: "(" + " OR ".join(f"contains(lower({x}), {sql_text(w)})" for w in words) + ")"
_SENTENCES = f"list_filter(string_split(regexp_replace({_strip_sql('html')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_ANY('s', intake.SENTENCE_WORDS)})[1:8]"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages hold none of the words that mark an insight; some get a list, some a paragraph that does."""
    return table(spark, d, "pages").select("page_id", "url", F.expr(_PAGE).alias("html"))


@query(f"""WITH p AS (SELECT page_id, {_PAGE} AS html FROM pages), i AS (SELECT page_id, list_transform(list_transform(regexp_extract_all(html, {sql_text(_LI)}, 1), lambda x: {_strip_sql('x')}), lambda x: CASE WHEN contains(x, 'Insights:') THEN substr(x, strpos(x, 'Insights:') + 9) ELSE x END) AS items, {_SENTENCES} AS sentences FROM p),
f AS (SELECT page_id, list_filter(list_transform(items, lambda x: trim(trim(x, ' ]'))), lambda x: x <> '' AND {_ANY('x', intake.INSIGHT_WORDS)})[1:8] AS kept, sentences FROM i),
o AS (SELECT page_id, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE sentences END) AS insight, generate_subscripts(CASE WHEN len(kept) > 0 THEN kept ELSE sentences END, 1) AS k FROM f)
SELECT page_id, k, insight, 'SIG-MIT-' || upper(substr(sha1(k || '||' || insight), 1, 10)) AS signal_id, 'MIT AI Incident Tracker insight ' || k AS title FROM o""")
def insight_extract(spark: SparkSession, d: str) -> DataFrame:
    """List items first, else sentences, as signals."""
    s = intake.insight_signals(_pages(spark, d), DAY)
    return s.select("page_id", F.regexp_extract("title", "([0-9]+)$", 1).cast("long").alias("k"), F.col("summary").alias("insight"), "signal_id", "title")


@query(f"WITH p AS (SELECT page_id, {_PAGE} AS html FROM pages) SELECT page_id, {_SENTENCES} AS sentences FROM p")
def insight_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The fallback for pages without list items."""
    return _pages(spark, d).select("page_id", intake.insight_sentences(F.col("html")).alias("sentences"))


_HEAD = "substr(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 1, 300)"


@query(f"""WITH c AS (SELECT 0 AS corpus, doc_id AS ord, text AS t FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 2, item_id, text FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY {_HEAD} ORDER BY corpus, ord) AS k, count(*) OVER (PARTITION BY {_HEAD}) AS n_copies FROM c WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '')
SELECT corpus, ord AS "order", n_copies FROM r WHERE k = 1""")
def combined_corpora(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("order"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("order"), "text")
    return corpus.corpora(docs.where("order % 3 = 0"), docs.where("order % 3 <> 0"), items).drop("text")


@query("""SELECT split, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5('42|' || doc_id), doc_id) AS r FROM (SELECT doc_id, toxic AS label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM labels WHERE toxic IS NOT NULL)) WHERE r <= 20""")
def split_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").selectExpr("doc_id", "toxic AS label", "CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split")
    train, test = corpus.split_routed(rows, 20, "doc_id", 42)
    return train.union(test).select("split", "doc_id", "label")


_TOKS = "list_filter(list_distinct(regexp_extract_all(lower({0}), " + sql_text(LINEAGE_TOKEN) + ")), lambda x: x NOT IN (" + ", ".join(map(sql_text, LINEAGE_STOP)) + "))"


@query(f"SELECT doc_id, CAST(len({_TOKS.replace('{0}', 'text')}) AS INTEGER) AS n_tokens, sha256(array_to_string(list_sort({_TOKS.replace('{0}', 'text')}), ' ')) AS tokens_sha FROM documents")
def lineage_token_sets(spark: SparkSession, d: str) -> DataFrame:
    toks = lineage_tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(toks).alias("n_tokens"), F.sha2(F.array_join(F.array_sort(toks), " "), 256).alias("tokens_sha"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(trim(b.text)))")
def lineage_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intake.verbatim(table(spark, d, "benchmark"), texts(spark, d))


# ---- dedupe and sampling ---------------------------------------------------


@query("SELECT doc_id, lang, source, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 300) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 300)) AS n_copies FROM documents) WHERE r = 1")
def prefix_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prefix_dedupe(texts(spark, d).select("doc_id", "text", "lang", "source"), "text", "doc_id").drop("text")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.hash_sample(table(spark, d, "documents").select("doc_id", "lang"), 25, "doc_id", 42, "lang")


@query("SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('7|' || doc_id), doc_id) AS r FROM labels WHERE toxic IS NOT NULL) WHERE r <= 40")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.balanced_sample(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 40, 7)


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.hash_sample(table(spark, d, "documents").select("doc_id"), 100, "doc_id", 42)


# ---- cases and outcomes ----------------------------------------------------

_TOOLS = "['Gmail' || l_shipmode, 'X' || l_shipmode]"


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in corpus.KEYWORD_TOOLS) + " ELSE 'external_action' END AS tool FROM (SELECT p_partkey, lower(CASE p_partkey % 9 WHEN 0 THEN 'GmailSendEmail' WHEN 1 THEN 'BankManagerTransferFunds' WHEN 2 THEN 'DropboxShare' WHEN 3 THEN 'TerminalWriteFile' WHEN 4 THEN 'EpicFHIRClinicalDoc' WHEN 5 THEN 'AugustLock' WHEN 6 THEN 'SlackNotify' WHEN 7 THEN p_name ELSE p_type END) AS n FROM part)")
def tool_map(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE p_partkey % 9 WHEN 0 THEN 'GmailSendEmail' WHEN 1 THEN 'BankManagerTransferFunds' WHEN 2 THEN 'DropboxShare' WHEN 3 THEN 'TerminalWriteFile' WHEN 4 THEN 'EpicFHIRClinicalDoc' WHEN 5 THEN 'AugustLock' WHEN 6 THEN 'SlackNotify' WHEN 7 THEN p_name ELSE p_type END")
    return table(spark, d, "part").select("p_partkey", corpus.map_tool(name).alias("tool"))


_SPLIT = "CASE c_custkey % 4 WHEN 0 THEN 'direct-harm-base' WHEN 1 THEN 'direct-harm-enhanced' WHEN 2 THEN 'data-stealing-base' ELSE 'data-stealing-enhanced' END"


@query(f"""SELECT c_custkey AS case_index, 'injecagent_' || CASE WHEN c_custkey % 4 <= 1 THEN 'dh' ELSE 'ds' END || '_' || CASE WHEN c_custkey % 2 = 1 THEN 'enhanced' ELSE 'base' END || '_' || printf('%04d', c_custkey) AS scenario_id,
 CASE WHEN c_custkey % 4 <= 1 THEN 'direct-harm' ELSE 'data-stealing' END AS attacker_goal, CASE c_custkey % 3 WHEN 0 THEN ['external_action', 'send_email'] WHEN 1 THEN ['transfer_funds'] ELSE [] END AS tools_mapped,
 list_sort(list_concat(['read_file', 'http_get', 'db_query'], CASE c_custkey % 3 WHEN 0 THEN ['external_action', 'send_email'] WHEN 1 THEN ['transfer_funds'] ELSE [] END)) AS available_tools, c_name AS user_task, coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, 'external_service') AS untrusted_source FROM customer""")
def adapt_cases(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").selectExpr(
        f"{_SPLIT} AS split", "c_custkey AS case_index", "c_name AS user_instruction", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS user_tool", "'x' AS tool_response",
        "CASE c_custkey % 3 WHEN 0 THEN array('GmailSendEmail', 'AugustLock', 'SlackNotify') WHEN 1 THEN array('BankPay') END AS attacker_tools", "'a' AS attack_type",
    )
    return corpus.adapt_cases(cases).select("case_index", "scenario_id", "attacker_goal", "tools_mapped", "available_tools", "user_task", "untrusted_source")


def _stats_sql(by: str) -> str:
    r = lambda n, d: f"CASE WHEN {d} > 0 THEN round({n} / {d}, 3) ELSE 0.0 END"
    return f"""SELECT grp, n, engaged, {r('engaged', 'n')} AS engagement_rate, followed, {r('followed', 'n')} AS attack_success_rate, provenance_caught, {r('provenance_caught', 'followed')} AS provenance_rate, precise_caught, {r('precise_caught', 'followed')} AS precise_rate, naive_caught, {r('naive_caught', 'followed')} AS naive_rate FROM (
 SELECT CASE WHEN grouping({by}) = 1 THEN 'all' ELSE coalesce({by}, 'unknown') END AS grp, count(*) AS n, count(*) FILTER (engaged) AS engaged, count(*) FILTER (followed) AS followed, count(*) FILTER (followed AND prov) AS provenance_caught, count(*) FILTER (followed AND prec) AS precise_caught, count(*) FILTER (followed AND naive) AS naive_caught FROM o GROUP BY ROLLUP ({by}))"""


@query(f"WITH {OUTCOMES_SQL} {_stats_sql('attacker_goal')}")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_stats(derived.outcomes(spark, d))


@query(f"WITH {OUTCOMES_SQL}, s AS ({_stats_sql('model')}) SELECT * EXCLUDE (grp), grp AS model, CASE WHEN contains(upper(grp), '1.5B') THEN '1.5B' WHEN contains(upper(grp), '3B') THEN '3B' ELSE 'unknown' END AS params FROM s WHERE grp <> 'all'")
def scaling_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.scaling_rows(derived.outcomes(spark, d))


@query(f"WITH {OUTCOMES_SQL} SELECT doc_id, CASE WHEN followed THEN 'FOLLOWED' WHEN engaged THEN 'ENGAGED' ELSE 'declined' END AS status, replace(replace(lower(model), '/', '_'), '.', '_') AS slug FROM o")
def outcome_status(spark: SparkSession, d: str) -> DataFrame:
    return derived.outcomes(spark, d).select("doc_id", behavior.outcome_status(F.col("followed"), F.col("engaged")).alias("status"), corpus.model_slug(F.col("model")).alias("slug"))


_HIT, _HELD = corpus.TRACE_HIT, corpus.TRACE_HELD
_EITHER = lambda key: f"CASE WHEN hit THEN {sql_text(_HIT[key])} ELSE {sql_text(_HELD[key])} END"
_TOLD = lambda t: f"replace(replace({sql_text(t['observed'])}, '''%s'' suite', '''' || suite || ''' suite'), '''%s'' attack', '''' || kind || ''' attack') || CASE WHEN done THEN {sql_text(t['done'])} ELSE {sql_text(t['undone'])} END"


@query(f"""WITH r AS (SELECT printf('%09d', e.event_id) AS file, e.event_type AS suite, CASE e.event_id % 4 WHEN 0 THEN 'none' ELSE 'direct' END AS kind, CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE 'i' || e.user_id END AS inj, e.event_id % 3 = 0 AS hit, e.event_id % 2 = 0 AS done, 'u' || e.user_id AS task FROM events e),
n AS (SELECT *, 7 + row_number() OVER (ORDER BY file) AS k FROM r WHERE kind <> 'none' AND inj IS NOT NULL)
SELECT 'ART-' || printf('%03d', k) AS trace_id, 'AgentDojo ' || suite || ' indirect prompt injection (' || kind || ') — ' || CASE WHEN hit THEN 'succeeded' ELSE 'defended' END AS title, CASE WHEN hit THEN {_TOLD(_HIT)} ELSE {_TOLD(_HELD)} END AS observed_behavior,
 {_EITHER('why')} AS why_it_matters, {_EITHER('confidence')} AS confidence, CASE WHEN hit THEN 'high' ELSE 'low' END AS severity, {_EITHER('recommended')} AS recommended_action, {_EITHER('mitigation_status')} AS mitigation_status, hit AS approval_required,
 {_EITHER('reason')} AS approval_reason, {_EITHER('gate')} AS approval_gate, {_EITHER('residual')} AS residual_risk, 'AgentDojo ' || suite || '/' || task || ' vs injection ' || inj || ' under ''' || kind || ''', converted to a structural trace with raw exploit text omitted.' AS reusable_eval_case, '2025-01-01' AS next_review FROM n""")
def benchmark_traces(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").selectExpr("lpad(cast(event_id as string), 9, '0') AS file", "event_type AS suite_name", "concat('u', user_id) AS user_task_id", "CASE event_id % 4 WHEN 0 THEN 'none' ELSE 'direct' END AS attack_type", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('i', user_id) END AS injection_task_id", "CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS security", "CASE WHEN event_id % 2 = 0 THEN true END AS utility")
    t = corpus.benchmark_traces(runs, next_review="2025-01-01")
    return t.select("trace_id", "title", "evidence.observed_behavior", "evidence.why_it_matters", "confidence", "severity", "recommended_action", "mitigation_status", F.col("human_approval.required").alias("approval_required"), F.col("human_approval.reason").alias("approval_reason"), "human_approval.approval_gate", "residual_risk", "reusable_eval_case", "next_review")


# ---- signals and rankings --------------------------------------------------

_PRIO = "least(100, (p_size % 7) * 4 + (1 + p_partkey % 5) * 8 + (1 + p_partkey % 4) * 5 + CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END * 6 + CASE p_partkey % 5 WHEN 0 THEN 12 WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 0 END)"
_REVIEW = "(p_partkey % 5 = 3 OR p_partkey % 4 = 0 OR p_partkey % 6 = 0)"
_SURF = "CASE WHEN p_partkey % 19 = 0 THEN [] ELSE [lower(p_type), 'governance'] END"


@query(f"SELECT 'P-' || p_partkey AS probe_id, 'SIG-' || p_partkey AS source_signal, CAST({_PRIO} AS INTEGER) AS priority, {_REVIEW} AS review_required, list_sort({_SURF}) AS affected_surfaces FROM part")
def signal_priority(spark: SparkSession, d: str) -> DataFrame:
    return triage.backlog(derived.signals(spark, d)).select("probe_id", "source_signal", "priority", "review_required", "affected_surfaces")


@query(f"SELECT 'P-' || p_partkey AS probe_id, CAST({_PRIO} AS INTEGER) AS priority FROM part ORDER BY priority DESC, probe_id LIMIT 20")
def backlog_rank(spark: SparkSession, d: str) -> DataFrame:
    return triage.backlog(derived.signals(spark, d)).select("probe_id", "priority").orderBy(F.desc("priority"), "probe_id").limit(20)


@query(f"""SELECT 'tier' AS dimension, CAST(p_partkey % 5 AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'total', 'signals', count(*) FROM part UNION ALL SELECT 'category', c, count(*) FROM (SELECT unnest([lower(p_brand), 'common']) AS c FROM part) GROUP BY c
UNION ALL SELECT 'surface', s, count(*) FROM (SELECT unnest({_SURF}) AS s FROM part) GROUP BY s UNION ALL SELECT 'queue', 'review', count(*) FROM part WHERE {_REVIEW} UNION ALL SELECT 'queue', 'do_not_reproduce', count(*) FROM part WHERE p_partkey % 6 = 0""")
def triage_summary(spark: SparkSession, d: str) -> DataFrame:
    return triage.signal_counts(derived.signals(spark, d))


_BAD = [
    ("p_partkey % 21 = 0", "missing required fields: risk_hypothesis"), ("p_partkey % 5 = 4", "invalid source_tier"), ("NOT (p_size % 7 BETWEEN 1 AND 5)", "novelty must be integer 1-5"), ("p_partkey % 6 = 1", "invalid raw_detail_policy"),
    ("p_partkey % 23 = 0", "proposed_probe missing safe_reproduction"), ("p_partkey % 19 = 0", "affected_surfaces cannot be empty"),
]


@query(f"SELECT 'SIG-' || p_partkey AS signal_id, list_filter([{', '.join(f'CASE WHEN {c} THEN {sql_text(m)} END' for c, m in _BAD)}], lambda x: x IS NOT NULL) AS errors FROM part")
def signal_validate(spark: SparkSession, d: str) -> DataFrame:
    return derived.signals(spark, d).select("signal_id", validate.signal_errors().alias("errors"))


@query("""WITH RECURSIVE s AS (SELECT 'KEY-' || upper(substr(sha1('http://x/' || p_partkey % 50 || '||' || lower(p_name)), 1, 10)) AS key, p_partkey AS ord, 'SIG-' || p_partkey AS signal_id, CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'note ' || p_partkey % 4 END AS notes FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS r FROM s),
f AS (SELECT key, r, signal_id, notes FROM o WHERE r = 1 UNION ALL SELECT f.key, o.r, f.signal_id, CASE WHEN o.notes <> '' AND NOT contains(f.notes, o.notes) THEN regexp_replace(f.notes || ' | ' || o.notes, '^[ |]+|[ |]+$', '', 'g') ELSE f.notes END FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1)
SELECT key, signal_id, notes FROM f WHERE r = (SELECT max(r) FROM o WHERE o.key = f.key)""")
def signal_merge(spark: SparkSession, d: str) -> DataFrame:
    return corpus.merge_signals(derived.signals(spark, d), "ord").select("key", "signal_id", "notes")


_DELTA = "p_name || p_partkey AS name, [lower(p_brand), 'size' || p_size % 7, 'x' || p_partkey % 11] AS surfaces, CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'b', 'c', 'd'] END AS new_authorities"
_RISK = "s_name AS name, ['size' || s_suppkey % 9, 'x' || s_suppkey % 13, 'governance'] AS surfaces, CASE s_suppkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['e', 'f'] ELSE ['e', 'f', 'g', 'h'] END AS known_evidence"
_CELL = "len(list_intersect(ds, rs)) * 4 + least(len(au), 3) * 2 + least(len(ev), 3)"
_SHARED = "list_sort(list_intersect(ds, rs))"


@query(f"""WITH dl AS (SELECT name AS delta, surfaces AS ds, new_authorities AS au FROM (SELECT {_DELTA} FROM part)), rk AS (SELECT name AS risk, surfaces AS rs, known_evidence AS ev FROM (SELECT {_RISK} FROM supplier))
SELECT delta, risk, CAST({_CELL} AS INTEGER) AS score, CASE WHEN {_CELL} >= 13 THEN 'probe_now' ELSE 'watchlist' END AS status, {_SHARED} AS overlap,
 'Create a synthetic fixture for ' || delta || ' x ' || risk || ' covering ' || array_to_string({_SHARED}, ', ') || '; avoid raw exploit content and score first useful intervention point.' AS safe_probe FROM dl, rk WHERE len(list_intersect(ds, rs)) > 0 AND {_CELL} >= 8""")
def delta_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Each part as a capability delta, each supplier as a risk."""
    none = "cast(array() as array<string>)"
    deltas = table(spark, d, "part").selectExpr("p_name || p_partkey AS name", "array(lower(p_brand), 'size' || p_size % 7, 'x' || p_partkey % 11) AS surfaces", f"CASE p_partkey % 4 WHEN 0 THEN {none} WHEN 1 THEN array('a') ELSE array('a', 'b', 'c', 'd') END AS new_authorities")
    risks = table(spark, d, "supplier").selectExpr("s_name AS name", "array('size' || s_suppkey % 9, 'x' || s_suppkey % 13, 'governance') AS surfaces", f"CASE s_suppkey % 3 WHEN 0 THEN {none} WHEN 1 THEN array('e', 'f') ELSE array('e', 'f', 'g', 'h') END AS known_evidence")
    return triage.delta_matrix(deltas, risks)


_HYP = "CAST(1 + s_suppkey % 5 AS INTEGER) AS likelihood, CAST(1 + s_suppkey % 4 AS INTEGER) AS impact, CAST(s_suppkey % 7 AS INTEGER) AS novelty, CAST(1 + s_suppkey % 3 AS INTEGER) AS actionability"
_HSC = "(likelihood * 10 + impact * 10 + actionability * 6 + novelty * 4)"


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_name AS risk_id", *_HYP.split(", "), "CASE s_suppkey % 4 WHEN 0 THEN 'none' ELSE 'high' END AS confidence", "array(concat('n', s_nationkey), 'all') AS affected_surfaces", "CASE WHEN s_suppkey % 6 = 0 THEN cast(array() as array<string>) ELSE array('e') END AS early_indicators", "array(named_struct('label', CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'l' END, 'url', 'u')) AS sources")


@query(f"SELECT risk_id, priority_score, CASE WHEN priority_score >= 125 THEN 'immediate assessment' WHEN priority_score >= 110 THEN 'near-term assessment' WHEN priority_score >= 95 THEN 'watchlist with probe' ELSE 'watchlist' END AS priority_band FROM (SELECT risk_id, CAST({_HSC} AS INTEGER) AS priority_score FROM (SELECT s_name AS risk_id, {_HYP} FROM supplier))")
def hypothesis_rank(spark: SparkSession, d: str) -> DataFrame:
    return triage.rank_hypotheses(_hypotheses(spark, d)).select("risk_id", "priority_score", "priority_band")


@query(f"SELECT risk_id, CAST({_HSC} AS INTEGER) AS priority_score FROM (SELECT s_name AS risk_id, {_HYP} FROM supplier) ORDER BY {_HSC} DESC, impact DESC, likelihood DESC, risk_id LIMIT 5")
def top_risks(spark: SparkSession, d: str) -> DataFrame:
    return triage.top_risks(triage.rank_hypotheses(_hypotheses(spark, d))).select("risk_id", "priority_score")


@query("SELECT s AS surface, count(*) AS n FROM (SELECT unnest(['n' || s_nationkey, 'all']) AS s FROM supplier) GROUP BY s")
def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    return triage.surface_coverage(_hypotheses(spark, d))


@query(f"""SELECT risk_id, list_filter([CASE WHEN NOT novelty BETWEEN 1 AND 5 THEN 'novelty must be integer 1-5' END, CASE WHEN k % 4 = 0 THEN 'confidence must be low, medium, or high' END, CASE WHEN k % 6 = 0 THEN 'early_indicators must be a non-empty list' END,
 CASE WHEN k % 8 = 0 THEN 'each source must include label and url' END], lambda x: x IS NOT NULL) AS errors FROM (SELECT s_suppkey AS k, s_name AS risk_id, {_HYP} FROM supplier)""")
def hypothesis_validate(spark: SparkSession, d: str) -> DataFrame:
    return _hypotheses(spark, d).select("risk_id", validate.hypothesis_errors().alias("errors"))


# ---- intake ----------------------------------------------------------------

_ID = lambda prefix, *parts: f"'{prefix}-' || upper(substr(sha1({' || {} || '.format(sql_text('||')).join(parts)}), 1, 10))"


def _signal_sql(source: str, frm: str, prefix: str, key: list[str], **given: str) -> str:
    """A SELECT of the 18 fields, the probe's spelt out, from SQL expressions; texts are clean already where they must be."""
    quoted = lambda v: f"[{', '.join(map(sql_text, v))}]" if isinstance(v, list) else sql_text(v) if isinstance(v, str) else f"CAST({v} AS INTEGER)"
    values = {"notes": "''", **{k: quoted(v) for k, v in intake.SOURCES[source].items()}, "signal_id": _ID(f"SIG-{prefix}", *key), "probe_id": _ID(f"PROBE-{prefix}", *key), **given}
    fields = [f for f in intake.FIELDS if f != "proposed_probe"] + intake.PROBE
    return f"SELECT {', '.join(f'{values[f]} AS {f}' for f in fields)}, {values.get('place', 'NULL')} AS place FROM {frm}"


_KEY = "coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END, ''), p_brand)"
_NAME = "coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), p_type)"
_CURL = "coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'http://c/' || c_custkey END, ''), 'manual-curation')"
_XURL = "CASE WHEN user_id % 3 = 0 THEN 'https://x.com/u' || user_id || '/status/' || event_id ELSE 'https://x.com/i/web/status/' || event_id END"
_XTEXT = "repeat(event_type || ' ', CAST(1 + event_id % 60 AS INTEGER))"
#: The sources as SQL; `place` orders all their records.
INTAKE_SQL = " UNION ALL ".join([
    _signal_sql("arxiv", "part, (VALUES ('agents', 'q1', 'ingress', 0), ('tools', 'q2', 'final', 1)) t(q, qt, st, qn)", "ARXIV", ["q", "'http://a/' || (p_partkey % 300)"], title="p_name || ' ' || (p_partkey % 300)", source_url="'http://a/' || (p_partkey % 300)", observed_at="'2024-01-03'", summary="'s'",
                affected_surfaces="['s']", risk_categories="['c']", description="'Review the paper and convert any safe, relevant finding into a probe for ' || q || '.'", expected_detection_stage="st", notes="'Generated from arXiv query: ' || qt", place="'a' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || qn"),
    _signal_sql("lookup", "nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) x ON s_nationkey = n_nationkey", "AIID", ["'http://n/' || n_nationkey"], title="'AIID lookup for http://n/' || n_nationkey", source_url="'http://n/' || n_nationkey", observed_at="'2024-01-01'",
                summary="'AIID lookup returned ' || coalesce(k, 0) || ' matching result(s) for the source URL.'", evidence_status="CASE WHEN k > 0 THEN 'corroborated' ELSE 'unverified' END", actionability="CASE WHEN k > 0 THEN 3 ELSE 2 END", notes="'lookup_result_count=' || coalesce(k, 0)", place="'b' || lpad(CAST(n_nationkey AS VARCHAR), 12, '0')"),
    _signal_sql("snapshot", "part", "AIID", [_KEY, _NAME], title=_NAME, source_url="'manual-snapshot'", observed_at="'2024-01-01'", summary=_NAME, place="'c' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')"),
    _signal_sql("post", f"(SELECT *, trim({_XTEXT}) AS t FROM events) e", "X", [_XURL, _XTEXT], title="'X weak signal from ' || CASE WHEN user_id % 3 = 0 THEN '@u' || user_id ELSE 'X post' END", source_url=_XURL, observed_at="'2024-01-01'", summary="CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 217)) || '...' END",
                place="'d' || lpad(CAST(event_id AS VARCHAR), 12, '0')"),
    _signal_sql("curated", "customer", "SOCIAL", [_CURL, "c_name"], title="c_name", source_url=_CURL, observed_at="'2024-01-01'", summary="'Manual weak signal requiring review.'", source_reliability="CAST(2 AS INTEGER)", actionability="CAST(3 AS INTEGER)", risk_categories="['jailbreak_motif']",
                affected_surfaces="list_filter(list_transform(string_split(coalesce(nullif(CASE c_custkey % 4 WHEN 0 THEN '' ELSE ' a , ,b' || c_nationkey END, ''), 'ingress,final_output'), ','), lambda x: trim(x)), lambda x: x <> '')", novelty="CASE WHEN c_custkey % 7 = 0 THEN 4 ELSE CAST(c_custkey % 7 AS INTEGER) END", place="'e' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')"),
])


def _intake(spark: SparkSession, d: str) -> DataFrame:
    """Signals of all sources, with `place`."""
    cfg = spark.createDataFrame([("agents", ["s"], ["c"], "ingress", "q1"), ("tools", ["s"], ["c"], "final", "q2")], "name string, affected_surfaces array<string>, risk_categories array<string>, proposed_probe_stage string, query string")
    entries = table(spark, d, "part").selectExpr("p_partkey", "'i' AS entry_id", "concat(p_name, '  ', p_partkey % 300) AS title", "'s' AS summary", "'2024-01-02' AS published", "'2024-01-03' AS updated", "concat('http://a/', p_partkey % 300) AS link")
    urls, incidents = table(spark, d, "nation").selectExpr("n_nationkey", "concat('http://n/', n_nationkey) AS url"), table(spark, d, "supplier").selectExpr("concat('http://n/', s_nationkey) AS url")
    items = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN cast(p_partkey as string) ELSE '' END AS incident_id", "p_brand AS id", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title", "p_type AS name")
    posts = table(spark, d, "events").selectExpr("event_id", "user_id AS author_id", "repeat(concat(event_type, ' '), cast(1 + event_id % 60 as int)) AS text", "cast(null as string) AS created_at")
    users = table(spark, d, "events").select("user_id").distinct().where("user_id % 3 = 0").selectExpr("user_id AS author_id", "concat('u', user_id) AS username")
    records = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('http://c/', c_custkey) END AS url", "c_name AS title", "CASE c_custkey % 4 WHEN 0 THEN '' ELSE concat(' a , ,b', c_nationkey) END AS affected_surfaces", "cast(c_custkey % 7 as string) AS novelty")
    place = lambda letter, key, *more: F.concat(F.lit(letter), F.lpad(F.col(key).cast("string"), 12, "0"), *more).alias("place")
    found = [
        (intake.feed_signals(entries, cfg, DAY), place("a", "p_partkey", F.when(F.col("query_name") == "agents", "0").otherwise("1"))), (intake.incident_lookups(urls, incidents, DAY), place("b", "n_nationkey")), (intake.incident_snapshot(items, DAY), place("c", "p_partkey")),
        (intake.posts(posts, users, DAY), place("d", "event_id")), (intake.curated(records, DAY), place("e", "c_custkey")),
    ]
    out = None
    for signals, at in found:
        part = signals.select(*intake.FIELDS, at)
        out = part if out is None else out.unionByName(part)
    return out


@query(INTAKE_SQL)
def intake_signals(spark: SparkSession, d: str) -> DataFrame:
    """All 18 fields of the signals of five sources."""
    s = _intake(spark, d)
    return s.select(*[f for f in intake.FIELDS if f != "proposed_probe"], "proposed_probe.*", "place")


@query(f"""WITH s AS ({INTAKE_SQL}), f AS (SELECT arg_min(s, place) AS r FROM s GROUP BY lower(trim(source_url)), lower(trim(title)))
SELECT r.probe_id, r.signal_id AS source_signal, least(100, r.novelty * 4 + r.actionability * 8 + r.source_reliability * 5 + CASE r.evidence_status WHEN 'corroborated' THEN 6 ELSE 0 END + CASE r.source_tier WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 0 END) AS priority, r.title AS title,
 list_sort(r.risk_categories) AS risk_categories, list_sort(r.affected_surfaces) AS affected_surfaces, r.source_tier = 3 OR r.evidence_status = 'unverified' OR r.raw_detail_policy = 'do_not_reproduce' AS review_required, r.raw_detail_policy AS raw_detail_policy FROM f WHERE r.novelty BETWEEN 1 AND 5""")
def intake_to_backlog(spark: SparkSession, d: str) -> DataFrame:
    """From five sources to the probe backlog: adapters, merge, validation, ranking."""
    merged = corpus.merge_signals(_intake(spark, d), "place")
    good, _ = validate.split_valid(merged, validate.signal_errors())
    return triage.backlog(good)


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'https://x.com/u' || user_id || '/status/' || event_id ELSE 'https://x.com/i/web/status/' || event_id END AS url, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substr(t, 1, 217)) || '...' END AS summary
FROM (SELECT event_id, user_id, trim(repeat(event_type || ' ', CAST(1 + event_id % 60 AS INTEGER))) AS t FROM events)""")
def post_signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "user_id AS author_id", "repeat(concat(event_type, ' '), cast(1 + event_id % 60 as int)) AS text")
    users = table(spark, d, "events").select("user_id").distinct().where("user_id % 3 = 0").selectExpr("user_id AS author_id", "concat('u', user_id) AS username")
    return intake.posts(e.withColumn("created_at", F.lit(None)), users, DAY).select("event_id", F.col("source_url").alias("url"), "summary")


@query("""SELECT c_custkey, 'SIG-SOCIAL-' || upper(substr(sha1(coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'http://c/' || c_custkey END, ''), 'manual-curation') || '||' || c_name), 1, 10)) AS signal_id, 3 AS source_tier,
 list_filter(list_transform(string_split(coalesce(nullif(CASE c_custkey % 4 WHEN 0 THEN '' ELSE ' a , ,b' || c_nationkey END, ''), 'ingress,final_output'), ','), lambda x: trim(x)), lambda x: x <> '') AS affected_surfaces, CASE WHEN c_custkey % 5 = 0 THEN 4 ELSE CAST(c_custkey % 5 AS INTEGER) END AS novelty FROM customer""")
def curated_signals(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('http://c/', c_custkey) END AS source_url", "c_name AS title", "CASE c_custkey % 4 WHEN 0 THEN '' ELSE concat(' a , ,b', c_nationkey) END AS affected_surfaces", "cast(c_custkey % 5 as string) AS novelty")
    return intake.curated(r, DAY).select("c_custkey", "signal_id", "source_tier", "affected_surfaces", "novelty")


@query("""SELECT n_nationkey, 'SIG-AIID-' || upper(substr(sha1('http://n/' || n_nationkey), 1, 10)) AS signal_id, coalesce(k, 0) AS result_count, CASE WHEN k > 0 THEN 'corroborated' ELSE 'unverified' END AS evidence_status, CASE WHEN k > 0 THEN 3 ELSE 2 END AS actionability
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) x ON s_nationkey = n_nationkey""")
def incident_lookup(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "nation").selectExpr("n_nationkey", "concat('http://n/', n_nationkey) AS url")
    incidents = table(spark, d, "supplier").selectExpr("concat('http://n/', s_nationkey) AS url")
    return intake.incident_lookups(urls, incidents, DAY).select("n_nationkey", "signal_id", "result_count", "evidence_status", "actionability")


@query("""SELECT p_partkey, 'SIG-AIID-' || upper(substr(sha1(coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END, ''), p_brand) || '||' || coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), p_type)), 1, 10)) AS signal_id, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), p_type) AS title FROM part""")
def incident_snapshot(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN cast(p_partkey as string) ELSE '' END AS incident_id", "p_brand AS id", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS title", "p_type AS name", "cast(null as string) AS url", "cast(null as string) AS summary", "cast(null as string) AS date")
    return intake.incident_snapshot(items, DAY).select("p_partkey", "signal_id", "title")


@query("""SELECT p_partkey, q AS query_name, 'SIG-ARXIV-' || upper(substr(sha1(q || '||' || 'http://a/' || p_partkey), 1, 10)) AS signal_id, p_name || ' ' || p_partkey AS title, 'http://a/' || p_partkey AS source_url FROM part, (VALUES ('agents'), ('tools')) t(q)""")
def feed_signals(spark: SparkSession, d: str) -> DataFrame:
    entry = "concat('<entry><id>i', p_partkey, '</id><title>', p_name, '  ', p_partkey, '</title><summary>s</summary><published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated><link rel=\"self\" href=\"x\"/><link rel=\"alternate\" href=\"http://a/', p_partkey, '\"/></entry>')"
    feed = table(spark, d, "part").selectExpr("p_partkey", f"{entry} AS entry")
    cfg = spark.createDataFrame([("agents", ["s"], ["c"], "ingress", "q1"), ("tools", ["s"], ["c"], "final", "q2")], "name string, affected_surfaces array<string>, risk_categories array<string>, proposed_probe_stage string, query string")
    return intake.feed_signals(intake.feed_entries(feed), cfg, DAY).select("p_partkey", "query_name", "signal_id", "title", "source_url")

