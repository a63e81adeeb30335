"""Detector metrics, ranking metrics and learned models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import auc, binary_metrics, confusion_counts, entropy, ratio
from ..functions.patterns import PROMPT_INJECTION, portable
from ..operators import ml
from ..operators.triage import depth_band, transfer_band, two_set_verdict, verdict
from .registry import query, sql_text, table, texts

_PRED = "(length(d.text) % 3 = 0)"
_NAN = "CAST('nan' AS DOUBLE)"


def _metrics_sql(source: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    end = f"GROUP BY {by}" if by else ""
    w = lambda p, n, s: f"CASE WHEN {n} = 0 OR isnan({p}) THEN {_NAN} ELSE {'greatest(0.0, ' if s == '-' else 'least(1.0, '}(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})) {s} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n})) END"
    return f"""c AS (SELECT {g}count(*) FILTER (pred AND label = 1) AS tp, count(*) FILTER (pred AND label = 0) AS fp, count(*) FILTER (NOT pred AND label = 0) AS tn, count(*) FILTER (NOT ((pred AND label = 1) OR (pred AND label = 0) OR (NOT pred AND label = 0))) AS fn FROM {source} {end}),
c2 AS (SELECT *, tp + fp + tn + fn AS n, tp + fn AS n_pos, fp + tn AS n_neg FROM c),
c3 AS (SELECT *, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE {_NAN} END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {_NAN} END AS precision, CASE WHEN n_neg > 0 THEN fp / n_neg ELSE {_NAN} END AS fpr FROM c2),
c4 AS (SELECT *, CASE WHEN NOT isnan(precision + recall) AND precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE {_NAN} END AS f1, {w('recall', 'n_pos', '-')} AS recall_lo, {w('recall', 'n_pos', '+')} AS recall_hi, {w('fpr', 'n_neg', '-')} AS fpr_lo, {w('fpr', 'n_neg', '+')} AS fpr_hi FROM c3)"""


_SRC = f"p AS (SELECT d.lang, {_PRED} AS pred, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    # text lengths are all that leaves the documents before the join
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.length("text") % 3 == 0).alias("pred"), F.length("text").alias("len"))
    return docs.join(table(spark, d, "labels").select("doc_id", "toxic", "quality"), "doc_id")


@query(f"WITH {_SRC}, {_metrics_sql('p')} SELECT * FROM c4")
def binary_metrics_wilson(spark: SparkSession, d: str) -> DataFrame:
    return binary_metrics(_scored(spark, d), F.col("pred"), F.col("toxic"))


@query(f"WITH {_SRC}, {_metrics_sql('p', 'lang')} SELECT * FROM c4")
def binary_metrics_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return binary_metrics(_scored(spark, d), F.col("pred"), F.col("toxic"), "lang")


@query(f"""WITH {_SRC}, c AS (SELECT lang, count(*) FILTER (pred AND label = 1) AS tp, count(*) FILTER (pred AND label = 0) AS fp, count(*) FILTER (NOT pred AND label = 0) AS tn, count(*) FILTER (NOT pred AND label = 1) AS fn FROM p GROUP BY lang)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c""")
def confusion_rows(spark: SparkSession, d: str) -> DataFrame:
    c = _scored(spark, d).groupBy("lang").agg(*confusion_counts(F.col("pred"), F.col("toxic")))
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)})


_AUC = """g AS (SELECT {0} length(d.text) AS s, sum(l.quality) AS pos, sum(1 - l.quality) AS neg FROM documents d JOIN labels l USING (doc_id) GROUP BY {0} s),
h AS (SELECT *, coalesce(sum(neg) OVER ({1} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@query(f"WITH {_AUC.format('', '')} SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CAST(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE) AS auc FROM h")
def auc_ranksum(spark: SparkSession, d: str) -> DataFrame:
    return auc(_scored(spark, d), "len", "quality")


@query(f"WITH {_AUC.format('lang,', 'PARTITION BY lang')} SELECT lang, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE) END AS auc FROM h GROUP BY lang")
def auc_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return auc(_scored(spark, d), "len", "quality", "lang")


_SOFT = "list_transform(e, lambda x: exp(x) / list_sum(list_transform(e, lambda y: exp(y))))"


@query(f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT vec_id, {_SOFT} AS p FROM v) SELECT vec_id, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))), 6) AS entropy FROM s")
def vector_entropy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x))
    return e.withColumn("t", total).select("vec_id", F.round(entropy(F.transform("e", lambda x: F.exp(x) / F.col("t"))), 6).alias("entropy"))


@query("SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, round(avg(x), 5) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    return ml.mean_pool(table(spark, d, "embeddings"), "embedding", "label", 5)


_MARGIN = """{0} AS (SELECT lang, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE) END AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
 (SELECT lang, {1} AS s, sum(l.quality) AS pos, sum(1 - l.quality) AS neg FROM documents d JOIN labels l USING (doc_id) GROUP BY lang, s)) GROUP BY lang)"""


@query(f"WITH {_MARGIN.format('a', 'length(d.text)')}, {_MARGIN.format('b', 'd.n_chars % 97')} SELECT lang, a.auc AS auc, b.auc AS control_auc, a.auc - b.auc AS margin FROM a JOIN b USING (lang) WHERE a.auc IS NOT NULL")
def margins(spark: SparkSession, d: str) -> DataFrame:
    """How far one score's AUC is ahead of another's, by language."""
    rows = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("len"), (F.col("n_chars") % 97).alias("rest")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    a, b = auc(rows, "len", "quality", "lang").select("lang", "auc"), auc(rows, "rest", "quality", "lang").select("lang", F.col("auc").alias("control_auc"))
    return a.join(b, "lang").where("auc IS NOT NULL").withColumn("margin", F.col("auc") - F.col("control_auc"))


@query("""WITH x AS (SELECT n_nationkey, 0.5 + (n_nationkey % 5) * 0.125::DOUBLE AS p, 0.5 + (n_nationkey % 3) * 0.125::DOUBLE AS b, 0.5 + (n_nationkey % 4) * 0.0625::DOUBLE AS c FROM nation)
SELECT n_nationkey, CASE WHEN p > b AND c >= 0.6 THEN 'probe wins and generalises' WHEN p > b THEN 'probe wins, does not generalise' WHEN c >= 0.6 THEN 'mixed' ELSE 'null result' END AS verdict,
 CASE WHEN p > b AND c > b THEN CASE WHEN least(p, c) >= 0.6 THEN 'probe wins and generalises' ELSE 'probe wins, does not generalise' END WHEN least(p, c) >= 0.6 THEN 'mixed' ELSE 'null result' END AS both_sets,
 CASE WHEN c - b >= 0.05 THEN 'probe transfers better' WHEN c - b >= -0.05 THEN 'about equal' ELSE 'lexical control transfers better' END AS transfer, CASE WHEN p - c >= 0.15 THEN 'deep layers add signal' ELSE 'embedding suffices' END AS depth FROM x""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").selectExpr("n_nationkey", "0.5D + (n_nationkey % 5) * 0.125D AS p", "0.5D + (n_nationkey % 3) * 0.125D AS b", "0.5D + (n_nationkey % 4) * 0.0625D AS c")
    p, b, c = F.col("p"), F.col("b"), F.col("c")
    return n.select("n_nationkey", verdict(p, b, c).alias("verdict"), two_set_verdict([p, c], [b, b], [p, c]).alias("both_sets"), transfer_band(c - b).alias("transfer"), depth_band(p - c).alias("depth"))


@query(None)
def tfidf_lr(spark: SparkSession, d: str) -> DataFrame:
    """Word n-gram classifier of quality labels: train and held-out metrics."""
    docs = texts(spark, d).select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return ml.tfidf_report(docs)


@query(None)
def layer_grid(spark: SparkSession, d: str) -> DataFrame:
    """Slices of the vectors as layers: all layers and folds of a probe fitted together, the best layer and layer 0 as control."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 2).cast("int").alias("label"))
    layers = e.select("vec_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("layer"), F.slice("e", 16 * i + 1, 16).alias("v")))).alias("s")).where("size(s.v) = 16")
    return ml.layer_report(layers.select(F.col("vec_id").alias("key"), F.col("s.layer").alias("layer"), array_to_vector("s.v").alias("vector"), "label"))


@query(None)
def layer_probe(spark: SparkSession, d: str) -> DataFrame:
    """A linear probe on vectors: cross-validated AUC of each label against the rest, beside the best and the mean over labels."""
    aucs = ml.probe_report(table(spark, d, "embeddings"))
    return aucs.crossJoin(F.broadcast(ml.best_layer(aucs).select(F.col("layer").alias("best_layer"), F.col("auc").alias("best_auc"), "mean_auc")))  # one row


_ENTROPY = f"SELECT vec_id, label, round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))), 6) AS s FROM (SELECT vec_id, label, {_SOFT} AS p FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


@query(f"""WITH e AS ({_ENTROPY}), g AS (SELECT vec_id % 2 AS part, s, count(*) FILTER (label % 2 = 1) AS pos, count(*) FILTER (label % 2 = 0) AS neg FROM e WHERE label IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY part ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT part, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, CAST(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS DOUBLE) AS auc FROM h GROUP BY part""")
def entropy_baseline(spark: SparkSession, d: str) -> DataFrame:
    """AUC of the entropy scalar alone, for each half of the vectors."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL").selectExpr("vec_id % 2 AS part", "cast(label % 2 as int) AS y", "cast(embedding as array<double>) AS e")
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x))
    scored = e.withColumn("t", total).select("part", "y", F.round(entropy(F.transform("e", lambda x: F.exp(x) / F.col("t"))), 6).alias("s"))
    return auc(scored, "s", "y", "part")


@query(None)
def cross_dataset(spark: SparkSession, d: str) -> DataFrame:
    """AUC of a vector probe, and of a lexical control, fitted on one half of the rows and scored on the other."""
    vectors = table(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 2).cast("int").alias("label"))
    docs = texts(spark, d).select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").where("label IS NOT NULL AND text IS NOT NULL")
    halves = lambda df, key: [df.where(F.pmod(F.xxhash64(key), F.lit(2)) == i) for i in (0, 1)]
    v, t = halves(ml.probe_rows(vectors, "vec_id", "e"), "key"), halves(docs, "doc_id")
    rows = [(f"half {i}", f"half {1 - i}", ml.cross_dataset_auc(v[i], v[1 - i]), ml.lexical_auc(t[i], t[1 - i])) for i in (0, 1)]
    return spark.createDataFrame(rows, "train string, test string, probe_auc double, lexical_auc double")


_HITS = " + ".join(f"CAST(regexp_matches(c, {sql_text('(?i)' + portable(p))}) AS INTEGER)" for p in PROMPT_INJECTION)


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(0, greatest(1, len(ws)), 512), lambda k: array_to_string(ws[k + 1 : k + 512], ' '))) AS c FROM w)
SELECT doc_id, max(1 - 0.5 ** ({_HITS})) AS score, max(1 - 0.5 ** ({_HITS})) >= 0.5 AS positive FROM p GROUP BY doc_id""")
def model_tier(spark: SparkSession, d: str) -> DataFrame:
    """The model tier with the built-in pattern scorer."""
    return ml.score_texts(texts(spark, d).select("doc_id", "text"))
