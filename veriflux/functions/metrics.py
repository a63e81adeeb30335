"""Classification metrics as aggregate and scalar expressions.

Two families differ where a denominator is zero: `nan` for detector benchmarks,
0.0 for rubric and detonation reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96

#: Ranges of scores for each step of their natural logarithm.
RANGES = 256


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def confusion_counts(pred: Column, label: Column) -> list[Column]:
    """tp, fp, tn, fn; a label that is neither 0 nor 1 counts as fn."""
    tp, fp, tn = pred & (label == 1), pred & (label == 0), ~pred & (label == 0)
    one = lambda c: F.coalesce(c, F.lit(False))
    return [F.count_if(one(tp)).alias("tp"), F.count_if(one(fp)).alias("fp"), F.count_if(one(tn)).alias("tn"), F.count_if(~one(tp) & ~one(fp) & ~one(tn)).alias("fn")]


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """95 percent Wilson interval, clamped to [0, 1]; nan where it is undefined."""
    nan = F.lit(float("nan"))
    bad = (n == 0) | F.isnan(p)
    denom = 1 + Z**2 / n
    centre = (p + Z**2 / (2 * n)) / denom
    margin = Z * F.sqrt(p * (1 - p) / n + Z**2 / (4 * n * n)) / denom
    return F.when(bad, nan).otherwise(F.greatest(F.lit(0.0), centre - margin)), F.when(bad, nan).otherwise(F.least(F.lit(1.0), centre + margin))


def binary_metrics(df: DataFrame, pred: Column, label: Column, *by: str) -> DataFrame:
    """Counts, recall, precision, fpr, f1 (nan where undefined) and Wilson intervals of recall and fpr."""
    nan = float("nan")
    c = df.groupBy(*by).agg(*confusion_counts(pred, label))
    c = c.withColumns({"n": F.expr("tp + fp + tn + fn"), "n_pos": F.expr("tp + fn"), "n_neg": F.expr("fp + tn")})
    c = c.withColumns({"recall": ratio(F.col("tp"), F.col("n_pos"), nan), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), nan), "fpr": ratio(F.col("fp"), F.col("n_neg"), nan)})
    both = F.col("precision") + F.col("recall")
    f1 = F.when(~F.isnan(both) & (both > 0), 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(nan))
    rlo, rhi = wilson(F.col("recall"), F.col("n_pos"))
    flo, fhi = wilson(F.col("fpr"), F.col("n_neg"))
    return c.withColumns({"f1": f1, "recall_lo": rlo, "recall_hi": rhi, "fpr_lo": flo, "fpr_hi": fhi})


def class_metrics(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Support, tp, fp, fn, precision, recall, f1 (0.0 where undefined) for the union of both sides' classes.

    One shuffle: each row votes for its expected and its predicted class.
    """
    votes = df.select(F.explode(F.array(
        F.struct(F.col(expected).alias("category"), F.lit(1).alias("e"), (F.col(expected) == F.col(predicted)).cast("int").alias("hit"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("category"), F.lit(0).alias("e"), F.lit(0).alias("hit"), F.lit(1).alias("p")),
    )).alias("v")).select("v.*")
    c = votes.groupBy("category").agg(F.sum("e").alias("n_expected"), F.sum("hit").alias("tp"), (F.sum("p") - F.sum("hit")).alias("fp"), (F.sum("e") - F.sum("hit")).alias("fn"))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0)})
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Exact ROC AUC, ties at half: from counts by distinct score.

    Scores are ranked within ranges, and ranges among each other, so no task
    ranks all scores. A range holds scores that agree in a rounded logarithm,
    which keeps their order.
    """
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    x = F.col(score).cast("double")
    counts = counts.withColumn("range_", F.floor(F.signum(x) * F.log1p(F.abs(x)) * RANGES).cast("long"))
    until = lambda order, *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    c = counts.withColumn("neg_below", sum_before("neg", until(score, *by, "range_")))
    parts = c.groupBy(*by, "range_").agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # ranges are few: RANGES for each step of the logarithm
    parts = parts.withColumn("won", F.col("won") + F.col("pos") * sum_before("neg", until("range_", *by) if by else until("range_", F.lit(0))))
    out = parts.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("won") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def entropy(p: Column) -> Column:
    """-sum p ln p of an array of doubles, p clamped below at 1e-12."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.greatest(x, F.lit(1e-12)) * F.ln(F.greatest(x, F.lit(1e-12))))
