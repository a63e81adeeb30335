"""Learned detectors: word n-gram classifier, vector probe, and the hook for external models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import confusion_counts
from ..functions.patterns import PROMPT_INJECTION
from ..sources.shared import Scratch
from .grams import TfIdf, gram_table

#: Folds of a probe; buckets in which rows are ranked.
FOLDS, BUCKETS = 5, 1024
#: Of probes: penalty, most Newton steps, rows handled at once, bytes of second derivatives held by a task.
PENALTY, MAX_STEPS, BLOCK_ROWS, HESSIANS_BYTES = 0.01, 30, 2048, 64_000_000


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with balanced class weights n / (classes * n_class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("nc"))
    total = counts.agg(F.sum("nc").alias("n"), F.count("*").alias("k"))
    w = counts.join(F.broadcast(total)).select(label, (F.col("n") / (F.col("k") * F.col("nc"))).alias("weight"))  # one row
    return df.join(F.broadcast(w), label)  # one row for each class


def split_fold(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """Rows with a fold from a hash of the key: the same in any partitioning."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)))


def tfidf_report(docs: DataFrame) -> DataFrame:
    """Confusion counts on training folds and the held-out fold, for docs(doc_id, text, label)."""
    tmp = Scratch(docs.sparkSession, "tfidf")
    rows = gram_table(split_fold(docs.where("label is not null and text is not null").select("doc_id", "label", "text"), "doc_id"), 3, tmp, "rows")
    scored = TfIdf(rows.where("fold <> 0"), 3, tmp=tmp).score(rows).select((F.col("fold") == 0).alias("held_out"), (F.col("prediction") == 1.0).alias("pred"), "label")
    return scored.groupBy("held_out").agg(*confusion_counts(F.col("pred"), F.col("label")))


def lexical_auc(train: DataFrame, test: DataFrame) -> float:
    """AUC of a word 1..2-gram control fitted on one data set, on another."""
    scored = TfIdf(train.select("label", "text"), max_n=2).score(test.select(F.col("label").cast("double").alias("label"), "text"))
    return BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(scored)


def probe() -> Pipeline:
    return Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="features", withMean=True), LogisticRegression(weightCol="weight", maxIter=30, regParam=PENALTY)])


def stratified_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """rows(key, label, and vector if there) with a fold: each label's rows are dealt in turn, in hash order.

    Fold sizes of a label differ by one at most, in any partitioning. Ranks are
    counted by hash bucket, so no task holds a whole label.
    """
    hashed = rows.withColumn("h", F.xxhash64("key", *([vector_to_array("vector")] if "vector" in rows.columns else []))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sizes = hashed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")  # BUCKETS rows for each label
    at = hashed.join(sizes.select("label", "bucket", before.alias("before")), ["label", "bucket"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h"))
    return at.withColumn("fold", F.pmod(rank, F.lit(folds)).cast("int")).drop("h", "bucket", "before")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray]]:
    """(layer, x, label, fold) of a few rows of one layer at a time."""
    for batch in batches:
        for part in (batch.slice(i, BLOCK_ROWS) for i in range(0, batch.num_rows, BLOCK_ROWS)):
            x, label, fold, layer = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), *(part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for each in np.unique(layer):
                mine = layer == each
                yield int(each), x[mine], label[mine], fold[mine]


def summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, object, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What add(out, layer, x, label, fold) adds up in an array of so many numbers, over all rows; partial sums meet in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for layer, x, label, fold in blocks(batches):
            add(out, layer, x, label, fold)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - mean) * scale, np.ones((len(x), 1))])


def fit_probes(rows: DataFrame, models: list[tuple], width: int, folds: int, layers: list[int]) -> dict[tuple, np.ndarray]:
    """For each (layer, class, fold), weights on raw vectors, the intercept last, fitted on the layer's other folds: see probe().

    Newton's method for many probes at a time: each step reads the rows once for
    all layers, classes and folds; second derivatives of different layers do not
    mix. A constant position gets weight 0.
    """
    place = {layer: i for i, layer in enumerate(layers)}

    def count(out, layer, x, label, fold):
        o = out.reshape(len(layers), folds, width + 1)[place[layer]]
        for k in range(folds):
            o[k] += np.r_[x[fold == k].sum(0), (fold == k).sum()]

    sums = summed(rows, len(layers) * folds * (width + 1), count).reshape(len(layers), folds, -1)
    sums = sums.sum(1, keepdims=True) - sums
    n, mean = sums[:, :, -1], sums[:, :, :-1] / np.maximum(sums[:, :, -1:], 1)

    def square(out, layer, x, label, fold):
        at = place[layer]
        o = out.reshape(len(layers), folds, width)[at]
        for k in range(folds):
            o[k] += ((x[fold != k] - mean[at, k]) ** 2).sum(0)

    sd = np.sqrt(summed(rows, len(layers) * folds * width, square).reshape(len(layers), folds, -1) / np.maximum(n[:, :, None] - 1, 1))
    scale = np.divide(1, sd, out=np.zeros_like(sd), where=sd > 0)
    found: dict[tuple, np.ndarray] = {}
    side = width + 1
    together = max(1, HESSIANS_BYTES // (8 * side * side))
    positives = {(r.layer, r.label, r.fold): r["count"] for r in rows.groupBy("layer", "label", "fold").count().collect()}
    for start in range(0, len(models), together):
        part = models[start : start + together]
        mine = [sum(positives.get((layer, c, f), 0) for f in range(folds) if f != k) for layer, c, k in part]
        weights = [(n[place[layer], k] / (2 * (n[place[layer], k] - m)), n[place[layer], k] / (2 * m)) for (layer, _, k), m in zip(part, mine)]
        penalty = np.r_[np.full(width, PENALTY), 0.0]
        each = 1 + side + side * side
        at, best, step, before = np.zeros((len(part), side)), np.zeros((len(part), side)), np.zeros((len(part), side)), np.full(len(part), np.inf)
        size = np.ones(len(part))
        for _ in range(MAX_STEPS):

            def slopes(out, layer, x, label, fold, at=at, part=part, weights=weights):
                here = place[layer]
                for k in {k for of, _, k in part if of == layer}:
                    z, own = scaled(x[fold != k], mean[here, k], scale[here, k]), label[fold != k]
                    for i, (of, c, f) in enumerate(part):
                        if f == k and of == layer:
                            y = own == c
                            m, w = z @ at[i], np.where(y, weights[i][1], weights[i][0])
                            p = 0.5 + 0.5 * np.tanh(m / 2)
                            o = out[i * each : (i + 1) * each]
                            o[0] += (w * np.logaddexp(0, np.where(y, -m, m))).sum()
                            o[1 : 1 + side] += z.T @ (w * (p - y))
                            o[1 + side :] += (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()

            got = summed(rows, len(part) * each, slopes).reshape(len(part), each) / np.array([[n[place[layer], k]] for layer, _, k in part])
            loss = got[:, 0] + (penalty * at**2).sum(1) / 2
            slope = got[:, 1 : 1 + side] + penalty * at
            better = loss <= before + 1e-12
            for i in np.flatnonzero(better):
                best[i], before[i], size[i] = at[i], loss[i], 1.0
                step[i] = np.linalg.solve(got[i, 1 + side :].reshape(side, side) + np.diag(penalty + 1e-12), slope[i])
            size[~better] /= 2
            if (better & (np.abs(slope).max(1) < 1e-7)).all():
                break
            at = best - size[:, None] * step
        for (layer, c, k), b in zip(part, best):
            raw = b[:-1] * scale[place[layer], k]
            found[layer, c, k] = np.r_[raw, b[-1] - raw @ mean[place[layer], k]]
    return found


def held_out_aucs(rows: DataFrame, fitted: dict[tuple, np.ndarray]) -> dict[tuple, float]:
    """Exact AUC of each probe on its fold. Scores are ranked by bucket, so no task ranks a whole fold."""
    names = list(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layer, x, label, fold in blocks(batches):
            for i, (of, c, k) in enumerate(names):
                if of == layer and len(own := label[fold == k]):
                    s = x[fold == k] @ fitted[of, c, k][:-1] + fitted[of, c, k][-1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array((own == c).astype(np.int64))], ["m", "score", "y"])

    scores = rows.mapInArrow(score, "m int, score double, y long").groupBy("m", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    scores = scores.withColumn("bucket", F.floor(BUCKETS * (0.5 + 0.5 * F.tanh(F.col("score") / 2))))
    below = F.sum("neg").over(Window.partitionBy("m", "bucket").orderBy("score")) - F.col("neg") / 2
    parts = scores.withColumn("won", F.col("pos") * below).groupBy("m", "bucket").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    under = F.sum("neg").over(Window.partitionBy("m").orderBy("bucket")) - F.col("neg")  # BUCKETS rows for each probe
    won = parts.withColumn("won", F.col("won") + F.col("pos") * under).groupBy("m").agg((F.sum("won") / F.sum("pos") / F.sum("neg")).alias("auc"))
    return {names[r.m]: r.auc for r in won.collect()}


def folded(rows: DataFrame, folds: int) -> DataFrame:
    """rows(key, vector, label, and layer if there) as (x, label, fold, layer); a key's fold is the same in all layers."""
    if "layer" not in rows.columns:
        dealt = stratified_folds(rows, folds).withColumn("layer", F.lit(0))
    else:
        dealt = rows.join(stratified_folds(rows.select("key", "label").distinct(), folds), ["key", "label"])
    return dealt.select(vector_to_array("vector").alias("x"), "label", "fold", F.col("layer").cast("int").alias("layer"))


def grid(rows: DataFrame, classes: list | None = None, folds: int = FOLDS) -> dict[tuple, float | None]:
    """AUC of each (layer, class) against the layer's other labels: see probes()."""
    rows = Scratch(rows.sparkSession, "probes").save(folded(rows, folds), "rows")
    sizes = {(r.layer, r.label, r.fold): r["count"] for r in rows.groupBy("layer", "label", "fold").count().collect()}
    layers, classes = sorted({layer for layer, _, _ in sizes}), sorted({c for _, c, _ in sizes}) if classes is None else classes
    models = []
    for layer in layers:
        in_fold = [sum(n for (at, _, f), n in sizes.items() if at == layer and f == k) for k in range(folds)]
        for c in classes:
            mine = [sizes.get((layer, c, k), 0) for k in range(folds)]
            models += [(layer, c, k) for k in range(folds) if 0 < mine[k] < in_fold[k] and 0 < sum(mine) - mine[k] < sum(in_fold) - in_fold[k]]
    aucs = held_out_aucs(rows, fit_probes(rows, models, len(rows.first().x), folds, layers)) if models else {}
    found = {(layer, c): [a for (of, x, _), a in aucs.items() if (of, x) == (layer, c)] for layer in layers for c in classes}
    return {k: sum(a) / len(a) if a else None for k, a in found.items()}


def probes(rows: DataFrame, classes: list | None = None, folds: int = FOLDS) -> dict:
    """AUC of each class (all labels, if none are given) against the other labels of rows(key, vector, label).

    It is the mean over folds; a fold counts if its rows, and the others, have
    both sides. Where none does, the class has None. Vectors are of equal length.
    """
    found = grid(rows, classes, folds)
    return {c: found.get((0, c)) for c in classes} if classes is not None else {c: a for (_, c), a in found.items()}


def layer_report(rows: DataFrame, control: int = 0, folds: int = FOLDS) -> DataFrame:
    """layer and auc of rows(key, layer, vector, label), label 1 against others, beside the best layer and a control layer.

    All layers and folds are fitted in the same passes. The best layer has the
    highest cross-validated AUC, ties to the lowest; a layer without both sides in
    any fold has null.
    """
    aucs = {layer: a for (layer, _), a in grid(rows, [1], folds).items()}
    known = [(a, -layer) for layer, a in aucs.items() if a is not None]
    best, at = max(known) if known else (None, None)
    table = [(layer, a, None if at is None else -at, best, aucs.get(control), sum(a for a, _ in known) / len(known) if known else None) for layer, a in sorted(aucs.items())]
    return rows.sparkSession.createDataFrame(table, "layer int, auc double, best_layer int, best_auc double, control_auc double, mean_auc double")


def cross_validated_auc(rows: DataFrame, folds: int = FOLDS) -> float | None:
    """Mean AUC over stratified folds of rows(key, vector, label), label 1 against the others."""
    return probes(rows, [1], folds)[1]


def cross_dataset_auc(train: DataFrame, test: DataFrame) -> float:
    return BinaryClassificationEvaluator().evaluate(probe().fit(weighted(train)).transform(test.withColumn("weight", F.lit(1.0))))


def entropy_features(rows: DataFrame, column: str) -> DataFrame:
    """One scalar as a feature vector, for the baseline of a probe."""
    return VectorAssembler(inputCols=[column], outputCol="vector").transform(rows)


def probe_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, label) as probes take them."""
    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), array_to_vector(vector).alias("vector"), "label")


def probe_report(vectors: DataFrame) -> DataFrame:
    """Cross-validated AUC of each non-null label (as layer) against the others; null where no fold has both sides."""
    v = vectors.where("label is not null and embedding is not null")
    v = v.select(F.col("vec_id").alias("key"), array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"), "label")
    return vectors.sparkSession.createDataFrame([(int(c), auc) for c, auc in probes(v).items()], "layer int, auc double")


def best_layer(aucs: DataFrame) -> DataFrame:
    return aucs.agg(F.max_by("layer", "auc").alias("layer"), F.max("auc").alias("auc"), F.avg("auc").alias("mean_auc"))


def rounded(x: Column, digits: int) -> Column:
    """x * 10**digits rounded and divided again; x itself where that is zero or not finite."""
    scaled = x * F.lit(10.0**digits)
    whole = F.round(F.abs(scaled)) / F.lit(10.0**digits)
    return F.when(F.isnan(scaled) | (F.abs(scaled) == float("inf")) | (scaled == 0), x).when(scaled < 0, -whole).otherwise(whole)


def mean_pool(rows: DataFrame, vector: str, by: str, digits: int) -> DataFrame:
    """Mean vector of each group, by position: partial sums fold before the shuffle.

    Means are rounded as doubles, half away from zero, and one that rounds to zero keeps its sign.
    """
    each = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = each.groupBy(by, "i").agg(F.avg("x").alias("x")).withColumn("m", rounded(F.col("x"), digits))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))  # as long as a vector


Scorer = Callable[[list[str]], list[float]]


def pattern_scorer(texts: list[str]) -> list[float]:
    """The built-in tier: the more injection patterns occur, ignoring case, the nearer to 1; external models take its place."""
    patterns = [re.compile(p, re.IGNORECASE) for p in PROMPT_INJECTION]
    return [1 - 0.5 ** sum(p.search(t) is not None for p in patterns) for t in texts]


def score_texts(texts: DataFrame, scorer: Scorer = pattern_scorer, batch: int = 32, window: int = 512) -> DataFrame:
    """Scores of an external model that reads `window` words at a time; a text has the highest of its windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts, owner = [], []
            for i, t in enumerate(f["text"]):
                words = (t or "").split()
                found = [" ".join(words[k : k + window]) for k in range(0, max(1, len(words)), window)]
                parts, owner = parts + found, owner + [i] * len(found)
            scores = [s for i in range(0, len(parts), batch) for s in scorer(parts[i : i + batch])]
            best = pd.Series(scores, dtype=float).groupby(owner).max().reindex(range(len(f))).to_numpy()
            yield pd.DataFrame({"doc_id": f["doc_id"].to_numpy(), "score": best, "positive": best >= 0.5})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, positive boolean")
