"""Numbers by files and places, whatever the partitioning."""

import json

import pytest

from veriflux.operators import corpus
from veriflux.sources import readers
from veriflux.sources.positions import paired, positioned


def lines(folder, name, rows):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_same_numbers_for_any_partitioning(spark, tmp_path):
    want = []
    for name, n in (("a/one.json", 700), ("a.json", 5), ("b.json", 400), ("c/two.json", 0)):
        lines(tmp_path, name, [{"v": f"{name}-{i}"} for i in range(n)])
    for name, n in (("a/one.json", 700), ("a.json", 5), ("b.json", 400)):  # folders before files whose names go on, as paths sort
        want += [f"{name}-{i}" for i in range(n)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("1m", "300b"):  # one task for all files, and dozens for each
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = spark.read.schema("v string").option("recursiveFileLookup", True).json(str(tmp_path))
            got = positioned(rows, "n", 3)
            assert [r.v for r in got.orderBy("n").collect()] == want
            assert sorted(r.n for r in got.collect()) == list(range(3, len(want) + 3))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_predictions_meet_labels(spark, tmp_path):
    lines(tmp_path, "labels.json", [{"label": i % 2} for i in range(500)])
    lines(tmp_path, "predictions.json", [{"score": i / 7} for i in range(500)])
    read = lambda name, schema: spark.read.schema(schema).json(str(tmp_path / name))
    got = paired(read("labels.json", "label int"), read("predictions.json", "score double")).collect()
    assert len(got) == 500 and all(r.label == r.position % 2 and r.score == r.position / 7 for r in got)
    lines(tmp_path, "short.json", [{"score": 1.0}])
    with pytest.raises(ValueError):
        paired(read("labels.json", "label int"), read("short.json", "score double"))


def test_case_numbers(spark, tmp_path):
    for split, files in (("direct-harm-base", (2, 3)), ("data-stealing-enhanced", (1,))):
        (tmp_path / split).mkdir()
        for k, n in enumerate(files):
            (tmp_path / split / f"{k}.json").write_text(json.dumps([{"User Instruction": f"{split}-{k}-{i}", "Attacker Tools": ["BankManagerTransferFunds"]} for i in range(n)]))
    cases = readers.cases(spark, {s: str(tmp_path / s) for s in ("direct-harm-base", "data-stealing-enhanced")})
    got = {r.user_task: r.scenario_id for r in corpus.adapt_cases(cases).collect()}
    assert [got[f"direct-harm-base-{k}"] for k in ("0-0", "0-1", "1-0", "1-1", "1-2")] == [f"injecagent_dh_base_{i:04d}" for i in range(5)]
    assert got["data-stealing-enhanced-0-0"] == "injecagent_ds_enhanced_0000"
