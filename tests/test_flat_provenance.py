"""Flat step tables against the folds over nested ones, as-of joins against a scan, and one very long trace."""

import random

from pyspark.sql import functions as F

from veriflux.operators import flat_provenance as flat
from veriflux.operators import operating, provenance
from veriflux.operators.asof import as_of
from veriflux.sources import schemas

SOURCES, TYPES = ["user", "trusted_tool", "untrusted_external", "other_agent", "system", None], ["message", "retrieval", "approval", "tool_call", "tool_call"]


def graphs(spark, seed=5, n=50):
    """Random traces with repeated step names, forward and unknown references, chains, and every kind of approval."""
    rng, rows = random.Random(seed), []
    for t in range(n):
        size, steps = rng.randrange(0, 14), []
        for i in range(size):
            name, chain = f"s{i}" if rng.random() < 0.85 else f"s{rng.randrange(max(1, i))}", rng.random() < 0.4
            parents = ([f"s{i - 1}"] if i else None) if chain else [f"s{rng.randrange(size + 1)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]
            steps.append((name, "user" if chain else rng.choice(SOURCES), rng.choice(TYPES), "c", rng.choice(["send_email", "read_file", "transfer_funds", "delete", None]), rng.choice([True, False, None]), None, parents, rng.choice([None, [], ["*"], ["transfer_funds"], ["send_email", "delete"]])))
        rows.append((f"T{t}", "x", None, None, steps))
    return spark.createDataFrame(rows, schemas.STEP_GRAPH).repartition(3)


def test_closure_and_alerts_equal_the_folds(spark):
    traces = graphs(spark)
    folded = provenance.with_taint(provenance.parse_steps(traces)).select("trace_id", F.explode("steps").alias("s")).where("size(s.roots) > 0")
    want = sorted((r.trace_id, r.s.idx, r.s.step_id, tuple(r.s.roots)) for r in folded.collect())
    got = flat.taint_roots(flat.exploded(traces))
    assert sorted((r.trace_id, r.idx, r.step_id, tuple(r.roots)) for r in got.collect()) == want and want
    want = sorted(repr(r.asDict()) for r in provenance.alerts(traces).select("trace_id", "step_id", "idx", "tool", "severity", "taint_sources", "taint_path").collect())
    assert sorted(repr(r.asDict()) for r in flat.flat_alerts(flat.exploded(traces)).collect()) == want and want


def test_no_steps(spark):
    none = spark.createDataFrame([], "trace_id string, idx long, step_id string")
    assert flat.taint_roots(none).collect() == [] and flat.flat_alerts(none).collect() == []


def test_a_trace_of_many_steps(spark):
    """One trace of 200,000 steps: a chain of half of them, a star, and approvals among actions."""
    n = 200_000
    steps = spark.range(n).selectExpr(
        "'hot' AS trace_id", "id AS idx", "concat('s', id) AS step_id", "CASE WHEN id IN (0, 150000) THEN 'untrusted_external' ELSE 'system' END AS source",
        "CASE WHEN id > 0 AND id % 1000 = 0 AND id <> 150000 THEN 'approval' WHEN id > 100000 THEN 'tool_call' ELSE 'message' END AS type", "CASE WHEN id > 100000 THEN CASE WHEN id % 2 = 0 THEN 'delete' ELSE 'read_file' END END AS tool",
        "CASE WHEN id IN (0, 150000) THEN array() WHEN id <= 100000 THEN array(concat('s', id - CASE WHEN id % 1000 = 1 AND id > 1 THEN 2 ELSE 1 END)) WHEN id > 150000 THEN array('s150000') ELSE array('s99999') END AS derived_from",
        "CASE WHEN id % 7000 = 0 THEN array('read_file') ELSE array('delete') END AS approves",
    ).repartition(7)
    roots = flat.taint_roots(steps)
    chain = [i for i in range(n) if not (i > 0 and i % 1000 == 0 and i != 150000)]
    assert roots.count() == len(chain)
    assert {(tuple(r.roots), r["count"]) for r in roots.groupBy("roots").count().collect()} == {(("s0",), sum(i < 150000 for i in chain)), (("s150000",), sum(i >= 150000 for i in chain))}
    # no approval of `delete` stands between s150000 and 151000; before it, those of the chain cover
    alerts = flat.flat_alerts(steps.where("idx >= 150000 or idx % 1000 = 0 or idx in (1, 99999)"))
    got = alerts.select("idx", "taint_path").collect()
    assert sorted(r.idx for r in got) == list(range(150000, 151000, 2))
    assert all(r.taint_path == ["s150000", f"s{r.idx}"][-1 - (r.idx > 150000) :] for r in got)


def test_as_of(spark):
    rng = random.Random(2)
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-20, 50)])) for _ in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-20, 50)]), rng.choice([None, 1, 2, 3])) for _ in range(80)]
    for strict in (False, True):
        for width in (1, 7, 1000):
            got = as_of(spark.createDataFrame(left, "k string, p long"), spark.createDataFrame(right, "k string, p long, v int").repartition(3), ["k"], "p", ["v"], strict, width).collect()
            assert len(got) == len(left)
            for r in got:
                found = [(p, v is not None, v) for k, p, v in right if k == r.k and k is not None and p is not None and r.p is not None and (p < r.p if strict else p <= r.p)]
                assert r.v == (max(found)[2] if found else None), r


def test_first_signals(spark):
    risks = spark.createDataFrame([(1, "a", "2024-01-10"), (2, "a", "2024-01-01"), (3, "b", "2024-01-10"), (4, None, "2024-01-10"), (5, "a", None)], "i int, cell string, created string").withColumn("created", F.col("created").cast("date"))
    signals = spark.createDataFrame([("a", "2024-01-02"), ("a", "2024-01-10"), ("a", "2024-02-01"), ("c", "2023-01-01")], "cell string, day string").select("cell", F.col("day").cast("date").alias("received"))
    got = {r.i: str(r.first_signal) for r in operating.with_first_signal(risks, signals).collect()}
    assert got == {1: "2024-01-10", 2: "None", 3: "None", 4: "None", 5: "None"}
