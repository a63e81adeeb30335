"""End-to-end pipelines: records in, typed results out, in one lineage each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import binary_metrics, class_metrics
from ..functions.patterns import KEYWORD, PROMPT_INJECTION
from ..functions.text import contains_any, matches, normalize
from ..operators import behavior, corpus, grams, intake, ml, monitor, network, ontology, provenance, sentinel, triage, validate
from ..sources import readers, records, web
from ..sources.schemas import TRACE_SCHEMA
from .report import Section, patch_loop, report


def validate_traces(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each trace file with its errors, by the built-in schema or by that of a file, and the summary of the valid ones."""
    by = readers.json_schema(schema) if schema else TRACE_SCHEMA
    checked = readers.documents(spark, path).withColumn("errors", validate.trace_errors(F.col("document"), by))
    get = lambda name: F.try_variant_get("document", f"$.{name}", "string").alias(name)
    checked = checked.select("file", *map(get, ("trace_id", "severity", "risk_category", "mitigation_status")), "errors")
    return checked, validate.trace_summary(checked.where(F.size("errors") == 0))


def risk_sentinel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    runs = readers.runs(spark, path)
    return sentinel.run_reports(runs), sentinel.summary(runs)


def stage_ablation(spark: SparkSession, path: str) -> DataFrame:
    return sentinel.ablation(readers.runs(spark, path))


def local_monitor(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    events = monitor.monitor_events(readers.sessions(spark, path))
    return events, monitor.monitor_summary(events)


def monitored(spark: SparkSession, path: str, rules: str | None = None) -> DataFrame:
    """Monitor events of saved sessions, by the built-in rules or by a rule pack."""
    pack = monitor.rules_of(readers.rule_pack(spark, rules)) if rules else monitor.RULES
    return monitor.monitor_events(readers.sessions(spark, path), pack)


def rubric_eval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Confusion counts of expected and found categories of saved evaluation cases, and metrics of each."""
    cases = readers.eval_cases(spark, path).select(F.coalesce("expected_failure_category", F.lit("good")).alias("expected"), validate.rubric_category(F.col("input_trace")).alias("predicted"))
    return cases.groupBy("expected", "predicted").agg(F.count("*").alias("n")), class_metrics(cases, "expected", "predicted")


def curated_signals(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return intake.curated(readers.curated_csv(spark, path), as_of)


def post_signals(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return intake.posts(*readers.posts_payload(spark, path), as_of)


def network_report(spark: SparkSession, path: str) -> Iterator[str]:
    nodes = network.assert_privacy_safe(readers.nodes(spark, path))
    events = network.events_of(nodes)
    return report("Shared signal triage", [Section("Counts", network.network_counts(nodes, events), ["dimension", F.desc("n"), "value"]), Section("Events", network.scored_events(events), [F.desc("score"), "event_id"])])


def sentinel_report(spark: SparkSession, path: str) -> Iterator[str]:
    runs = readers.runs(spark, path)
    return report("Lifecycle risk events", [Section("Summary", sentinel.summary(runs), ["first_detection_stage"]), Section("Runs", sentinel.run_reports(runs), ["run_id"]), Section("Ablation", sentinel.ablation(runs)), Section("Events", sentinel.events(runs), ["run_id", "stage_ord", "seq"])])


def monitor_report(spark: SparkSession, path: str, rules: str | None = None) -> Iterator[str]:
    events = monitored(spark, path, rules)
    return report("Local risk monitor", [Section("Counts", monitor.monitor_summary(events), ["dimension", F.desc("n"), "value"]), Section("Events", events.drop("evidence_excerpt"), ["session_id", "event_ord"])])


def triage_report(spark: SparkSession, path: str) -> Iterator[str]:
    signals = readers.signals(spark, path)
    return report("Signal triage", [Section("Counts", triage.signal_counts(signals), ["dimension", F.desc("n"), "value"]), Section("Backlog", triage.backlog(signals), [F.desc("priority"), "probe_id"])])


def eval_report(spark: SparkSession, path: str) -> Iterator[str]:
    confusion, by_class = rubric_eval(spark, path)
    return report("Rubric evaluation", [Section("Confusion", confusion, ["expected", "predicted"]), Section("Classes", by_class, ["category"])])


def detonation_report(spark: SparkSession, scenarios: str, traces: str) -> Iterator[str]:
    """Detection of attempted actions over detonated scenarios: counts, profiles and taint paths."""
    told = readers.scenarios(spark, scenarios).select(F.col("id").alias("scenario_id"), "ground_truth", behavior.naive_detector(F.col("user_task"), F.col("untrusted_content")).alias("naive"))
    detonated = readers.detonations(spark, traces)
    calls = detonated.select("trace_id", F.col("attempted_tool_calls_total").alias("attempted"), F.col("valid_tool_calls_total").alias("valid"))
    profiles = behavior.profile(detonated)
    results = profiles.join(told, "scenario_id").join(calls, "trace_id").select("ground_truth", F.size("attempted_privileged_actions").alias("n_privileged"), "attempted", "valid", F.col("detection_provenance_only").alias("loose"), F.col("detection_precise").alias("strict"), "naive")
    return report("Detonation results", [Section("Counts", behavior.factory_metrics(results)), Section("Profiles", profiles, ["trace_id"])])


def patch_loop_report(spark: SparkSession, path: str) -> Iterator[str]:
    """Reports of saved patch-loop cases, in the order of their ids; a case with a forbidden marker is an error."""
    cases = readers.patch_cases(spark, path).drop("file")
    marked = cases.withColumn("markers", validate.forbidden_markers(F.to_json(F.struct("*"))))
    for r in marked.orderBy("case_id").toLocalIterator():
        if r.markers:
            raise ValueError(f"{r.case_id} holds {', '.join(r.markers)}")
        yield from patch_loop(r.asDict(recursive=True)).split("\n")


def gate_report(spark: SparkSession, path: str) -> Iterator[str]:
    results = provenance.gate_results(readers.step_graphs(spark, path))
    return report("Provenance gate", [Section("Traces", results, ["trace_id"]), Section("Totals", provenance.gate_totals(results))])


def behavior_profiles(spark: SparkSession, path: str) -> DataFrame:
    return behavior.profile(readers.detonations(spark, path))


def outcome_report(spark: SparkSession, path: str) -> Iterator[str]:
    outcomes = readers.outcomes(spark, path)
    return report("Corpus outcomes", [Section("By goal", corpus.corpus_stats(outcomes), ["grp"]), Section("By model", corpus.scaling_rows(outcomes), ["model"])])


def ontology_report(texts: DataFrame, id_column: str) -> Iterator[str]:
    classified = ontology.classify(texts, id_column)
    return report("Ontology", [Section("Distribution", ontology.distribution(classified), ["axis", F.desc("n"), "node"]), Section("Rates", ontology.rates(classified))])


def signal_backlog(signals: DataFrame, order: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged, validated and ranked signals, and what was rejected; strict fails instead."""
    merged = corpus.merge_signals(signals, order)
    good, bad = validate.split_valid(merged, validate.signal_errors(), strict)
    return triage.backlog(good), bad


def matrix_report(spark: SparkSession, deltas: str, risks: str) -> Iterator[str]:
    cells = triage.delta_matrix(readers.deltas(spark, deltas), readers.risks(spark, risks))
    return report("Risk delta matrix", [Section("Cells", cells, [F.desc("score"), "delta", "risk"])])


def assessment_report(spark: SparkSession, path: str) -> Iterator[str]:
    good, _ = validate.split_valid(readers.hypotheses(spark, path), validate.hypothesis_errors(), strict=True)
    ranked = triage.rank_hypotheses(good)
    order = [F.desc("priority_score"), F.desc("impact"), F.desc("likelihood"), "risk_id"]
    return report("Strategic assessment", [Section("Ranking", ranked, order), Section("Surfaces", triage.surface_coverage(good), [F.desc("n"), "surface"])])


def page_insights(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    return intake.insight_signals(readers.pages(spark, path), as_of)


def feed_backlog(spark: SparkSession, feed: str, config: DataFrame, as_of: str) -> DataFrame:
    return intake.feed_signals(readers.atom_entries(spark, feed), config, as_of)


def scaling(spark: SparkSession, path: str) -> DataFrame:
    """Rates by model, computed again from saved outcomes."""
    return corpus.scaling_rows(readers.outcomes(spark, path))


def detector_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Counts, rates and intervals of each detector tier on labelled texts, by split; a text is read once for all tiers."""
    rows = readers.labelled_texts(spark, path)
    tiers = {"keyword": contains_any(normalize(F.col("text")), [KEYWORD]), "regex": matches(F.col("text"), PROMPT_INJECTION)}
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("tier"), hit.alias("hit")) for name, hit in tiers.items()]))
    each = rows.select(F.coalesce("split", F.lit("all")).alias("split"), "label", told.alias("t")).select("split", "label", "t.*")
    return binary_metrics(each, F.col("hit"), F.col("label"), "split", "tier")


def trained(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Trains the n-gram classifier on the rows of split `train`, scores the others, and saves model, vocabulary and metrics below `out`."""
    rows = readers.labelled_texts(spark, path).where("label is not null").select("label", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("split", F.lit("train")).alias("split"))
    model = grams.TfIdf(rows.where("split = 'train'").select("label", "text"))
    found = binary_metrics(model.score(rows), F.col("prediction") == 1.0, F.col("label"), "split")
    model.save(out, {r.split: {k: getattr(r, k) for k in ("n", "tp", "fp", "tn", "fn")} for r in found.collect()})  # a row for each split
    return found


def lexical_control(spark: SparkSession, left: str, right: str) -> DataFrame:
    """AUC of the lexical control fitted on each of two labelled files and scored on the other."""
    a, b = (readers.labelled_texts(spark, p).where("label is not null and text is not null") for p in (left, right))
    return spark.createDataFrame([("left", "right", ml.lexical_auc(a, b)), ("right", "left", ml.lexical_auc(b, a))], "train string, test string, auc double")


def probed(spark: SparkSession, path: str) -> DataFrame:
    """Probes of saved features(key, layer, vector, label): AUC by layer, the best one and layer 0 as control."""
    rows = spark.read.schema("key STRING, layer INT, vector ARRAY<DOUBLE>, label INT").json(path).where("label is not null and vector is not null")
    return ml.layer_report(rows.select("key", "layer", array_to_vector("vector").alias("vector"), "label"))


ITEM = "incident_id STRING, id STRING, number STRING, url STRING, title STRING, name STRING, description STRING, source_url STRING, report_url STRING, summary STRING, text STRING, date STRING, observed_at STRING"


def incidents(spark: SparkSession, where: str, as_of: str) -> DataFrame:
    """Signals of an incident snapshot, a file or an address: a list, or an object that holds one."""
    d = web.json_documents(spark, where)
    held = F.coalesce(*[F.try_variant_get("document", f"$.{k}", "array<variant>") for k in ("incidents", "reports", "results", "data")], F.array("document"))
    items = d.select(F.explode(held).alias("item")).select(F.from_json(F.to_json("item"), ITEM).alias("i")).select("i.*")
    return intake.incident_snapshot(items, as_of)


def lookups(spark: SparkSession, where: str, as_of: str, base: str = web.LOOKUP) -> DataFrame:
    """Signals of a JSON list of {url, title, observed_at}, by what the incident database knows of each address."""
    asked = web.json_documents(spark, where).select(F.from_json(F.to_json("document"), "url STRING, title STRING, observed_at STRING").alias("r")).select("r.*")
    return intake.lookup_signals(web.looked_up(spark, asked, base), as_of)


def feeds(spark: SparkSession, config: str, folder: str, as_of: str, base: str = web.FEED) -> DataFrame:
    """Fetches the feed of each configured query into `folder`, and gives signals of its entries."""
    queries, out = readers.query_config(spark, config), None
    for q in queries.collect():  # a configuration file
        web.feed_files(spark, [(q["query"], 5)], f"{folder}/{q['name']}", base=base).collect()
        part = intake.feed_signals(readers.atom_entries(spark, f"{folder}/{q['name']}"), queries.where(F.col("name") == q["name"]), as_of)
        out = part if out is None else out.union(part)
    return out


def trace_files(spark: SparkSession, path: str, out: str, batch: str) -> DataFrame:
    """Decision traces of benchmark runs, one file each, named by trace id; gives the ids."""
    traces = corpus.benchmark_traces(readers.benchmark_runs(spark, path))
    records.write_records(traces, out, "trace_id", batch)
    return traces.select("trace_id")
