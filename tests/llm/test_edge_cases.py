"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from veriflux.llm import embedding_dedup, exact_dedup, langid, minhash, mixing, packing, secrets, suffix_dedup, token_counts, toxicity

from . import cases

OPERATORS = {
    "langid": langid.identify,
    "toxicity": lambda df: toxicity.toxicity(df, cases.labels(df.sparkSession)),
    "suffix": suffix_dedup.remove_repeats,
    "secrets": secrets.scan,
    "exact": exact_dedup.exact_dedup,
    "mixing": mixing.mix,
    "packing": packing.pack,
    "minhash": minhash.minhash_dedup,
    "tokens": token_counts.token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    run, docs = OPERATORS[name], cases.frame(spark)
    if name == "packing":  # which sequence a piece goes to depends on the partitioning
        run = lambda df: packing.pack(df).drop("sequence_id", "offset")
    plain = cases.result(run(docs))
    ids = [r[0] for r in plain]
    for doc_id in {r[0] for r in cases.rows()}:
        assert doc_id in ids
    if name != "packing":
        assert len(plain) == len(cases.rows())
    assert cases.result(run(cases.clashing(docs).repartition(5))) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](cases.empty(spark)).collect() == []


def test_pipeline_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    for which, docs in (("some", cases.clashing(cases.frame(spark))), ("none", cases.empty(spark))):
        d = f"{tmp_path}/{which}"
        docs.write.parquet(f"{d}/documents.parquet")
        cases.labels(spark).write.parquet(f"{d}/labels.parquet")
        got = spark.read.parquet(f"{d}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = got.columns
            got = stage(spark, got, d)
            assert got.columns == columns, name
            got.write.parquet(f"{d}/{name}")
            got = spark.read.parquet(f"{d}/{name}")
        packed = corpus_pipeline.STAGES[-1][1](spark, got, d)
        assert (packed.count() == 0) == (which == "none")


def test_embeddings(spark):
    v = [1.0] + [0.0] * 7
    w = [1.0, 0.1] + [0.0] * 6
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, w, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 8, 0), (8, [float("nan")] + v[1:], 0), (9, [float("inf")] + v[1:], 0),
        (10, [1.0, None] + v[2:], 0), (11, [], 0), (12, [1.0, 0.0], 0), (None, v, 0), (13, [-x for x in v], 0), (14, [2.0] + v[1:], 0),
        (15, [3e38 * x for x in w], 7), (16, [1e-38 * x for x in v], 7),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = cases.result(embedding_dedup.embedding_dedup(df))
    linked = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert linked[1] == (4, 1, True) and linked[2] == (4, 1, False) and linked[3] == (4, 1, False) and linked[14] == (4, 1, False)
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert linked[alone] == (0, alone, True)
    assert linked[15] == (1, 15, True) and linked[16] == (1, 15, False)
    named = df.withColumn("label", F.concat(F.lit("n"), "label")).withColumn("embedding", F.expr("transform(embedding, x -> x * 1e200D)"))
    assert cases.result(embedding_dedup.embedding_dedup(named)) == got
    assert linked[None] == (0, None, True)
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept string")).collect() == []


def test_repeated_rows_leave_one(spark, tmp_path):
    import corpus_pipeline

    text, other = cases.rows()[0][1], "nothing in common with any of these rows here at all"
    rows = [(1, text), (1, text), (1, other), (0, text.upper()), (None, "no number one"), (None, "No number one"), (None, text), (7, None), (7, ""), (8, "  "), (8, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("again_id", F.lit("x")).withColumn("row", F.lit("y")).repartition(3)
    exact = corpus_pipeline.drop_copies(spark, df, "")
    assert exact.columns == df.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in exact.collect()]
    assert sorted(got, key=repr) == sorted([(1, text), (1, other), (None, "no number one"), (7, ""), (8, "  ")], key=repr)
    near = corpus_pipeline.drop_near_copies(spark, df, "")
    assert near.columns == df.columns
    got = [(r.doc_id, (r.text or "").lower()) for r in near.collect()]
    assert sorted(got, key=repr) == sorted([(0, text), (1, other), (None, "no number one"), (None, text), (7, ""), (8, "  ")], key=repr)
