"""python -m veriflux COMMAND PATH...: the pipelines from a command line.

Tables are printed as Markdown; with --output they are written as lines of JSON
instead, distributed and of any size.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import corpus, monitor, network, ontology, triage
from .plans import pipelines
from .plans.report import lines
from .sources import readers

TEXT = {"network": pipelines.network_report, "gate": pipelines.gate_report, "outcomes": pipelines.outcome_report, "matrix": pipelines.matrix_report, "assess": pipelines.assessment_report,
        "sentinel-report": pipelines.sentinel_report, "monitor-report": pipelines.monitor_report, "triage-report": pipelines.triage_report, "eval-report": pipelines.eval_report, "detonation-report": pipelines.detonation_report, "patch-loop": pipelines.patch_loop_report}


def _classified(spark: SparkSession, path: str) -> DataFrame:
    texts = readers.labelled_texts(spark, path).withColumn("text_id", F.sha1("text"))
    return ontology.classify(texts, "text_id")


#: Commands that give tables: what they print or write, and in which order.
TABLES = {
    "sentinel": lambda s, path: [(pipelines.risk_sentinel(s, path)[1], None)],
    "ablation": lambda s, path: [(pipelines.stage_ablation(s, path), None)],
    "monitor": lambda s, path, rules=None: [(monitor.monitor_summary(pipelines.monitored(s, path, rules)), ["dimension", "value"])],
    "events": lambda s, path, rules=None: [(pipelines.monitored(s, path, rules), ["session_id", "event_ord"])],
    "anonymize": lambda s, path: [(monitor.privacy_aggregate(readers.monitor_results(s, path)), None), (monitor.fingerprints(readers.monitor_results(s, path)), ["evidence_hash", "signature_id"])],
    "route": lambda s, path: [(network.scored_events(network.events_of(network.assert_privacy_safe(readers.nodes(s, path)))), [F.desc("score"), "event_id"])],
    "behavior": lambda s, path: [(pipelines.behavior_profiles(s, path), ["trace_id"])],
    "merge": lambda s, path: [(corpus.merge_signals(readers.signals(s, path).drop("file"), "signal_id"), ["key"])],
    "triage": lambda s, path: [(triage.signal_counts(readers.signals(s, path)), ["dimension", F.desc("n"), "value"]), (triage.backlog(readers.signals(s, path)), [F.desc("priority"), "probe_id"])],
    "classify": lambda s, path: [(ontology.distribution(_classified(s, path)), ["axis", F.desc("n"), "node"]), (ontology.rates(_classified(s, path)), None)],
    "eval": lambda s, path: [(t, o) for t, o in zip(pipelines.rubric_eval(s, path), (["expected", "predicted"], ["category"]))],
    "traces": lambda s, path: [(corpus.benchmark_traces(readers.benchmark_runs(s, path)), ["trace_id"])],
    "adapt": lambda s, *paths: [(corpus.adapt_cases(readers.cases(s, dict(p.split("=", 1) for p in paths))), ["scenario_id"])],
    "insights": lambda s, path, as_of: [(pipelines.page_insights(s, path, as_of), ["signal_id"])],
    "curated": lambda s, path, as_of: [(pipelines.curated_signals(s, path, as_of), ["signal_id"])],
    "posts": lambda s, path, as_of: [(pipelines.post_signals(s, path, as_of), ["event_id"])],
    "feed": lambda s, path, config, as_of: [(pipelines.feed_backlog(s, path, readers.query_config(s, config), as_of), ["signal_id"])],
    "fetch-feeds": lambda s, config, folder, as_of, *base: [(pipelines.feeds(s, config, folder, as_of, *base), ["signal_id"])],
    "incidents": lambda s, where, as_of: [(pipelines.incidents(s, where, as_of), ["signal_id"])],
    "lookup": lambda s, where, as_of, *base: [(pipelines.lookups(s, where, as_of, *base), ["signal_id"])],
    "scaling": lambda s, path: [(pipelines.scaling(s, path), ["model"])],
    "benchmark": lambda s, path: [(pipelines.detector_benchmark(s, path), ["split", "tier"])],
    "train": lambda s, path, out: [(pipelines.trained(s, path, out), ["split"])],
    "lexical": lambda s, left, right: [(pipelines.lexical_control(s, left, right), ["train"])],
    "probe": lambda s, path: [(pipelines.probed(s, path), ["layer"])],
    "trace-files": lambda s, path, out, batch: [(pipelines.trace_files(s, path, out, batch), ["trace_id"])],
}

#: What `all` runs, on the folder of that name below its own, where there is one.
EVERY = ["validate", "sentinel", "ablation", "monitor", "route", "behavior", "triage", "eval", "gate", "outcomes", "scaling", "benchmark", "classify", "assess", "patch-loop"]


def show(table: DataFrame, order: list | None) -> None:
    for line in lines(table, order):
        print(line)
    print()


def every(spark: SparkSession, folder: str) -> Iterator[tuple[str, str]]:
    """(command, ok, skipped or what went wrong), for each command that needs nothing but records; none stops the others."""
    for command in EVERY:
        path = f"{folder}/{command}"
        if not readers.exists(spark, path):
            yield command, "skipped: no such folder"
            continue
        try:
            code = run(spark, command, [path], None)
            yield command, "ok" if not code else f"failed: exit code {code}"
        except Exception as e:  # noqa: BLE001  the others still run
            yield command, f"failed: {str(e).splitlines()[0][:200]}"


def run(spark: SparkSession, command: str, paths: list[str], output: str | None) -> int:
    if command in TEXT:
        for line in TEXT[command](spark, *paths):
            print(line)
        return 0
    if command == "validate":
        checked, summary = pipelines.validate_traces(spark, *paths)
        bad = checked.where(F.size("errors") > 0).select("file", "trace_id", "errors")
        if checked.isEmpty():
            return 2
        tables = [(summary, ["dimension", "value"]), (bad, ["file"])]
    else:
        tables = TABLES[command](spark, *paths)
    for i, (table, order) in enumerate(tables):
        if output:
            readers.write_json(table, f"{output}/{command}-{i}")
        else:
            show(table, order)
    return int(command == "validate" and not bad.isEmpty())


def main(argv: list[str]) -> int:
    """0: done; 1: some traces are not valid, or a command of `all` failed; 2: nothing to read."""
    parser = argparse.ArgumentParser(prog="veriflux", description=__doc__)
    parser.add_argument("command", choices=[*TEXT, "validate", "all", *TABLES])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--output", help="write tables to this folder instead of printing them")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("veriflux").getOrCreate()
    if args.command == "all":
        told = list(every(spark, args.paths[0]))
        for command, result in told:
            print(f"{command}: {result}")
        return int(any(result.startswith("failed") for _, result in told))
    return run(spark, args.command, args.paths, args.output)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
