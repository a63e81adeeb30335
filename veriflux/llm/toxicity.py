"""Toxicity by weak supervision.

1. Voters come from the training labels: words and word beginnings that occur
   almost only in toxic documents (lexicon and pattern voters), a voter against
   for documents none of them knows, and the label itself, as one more voter
   that may be wrong.
2. A generative label model estimates each voter's rates under both classes by
   EM, and the correlation of every pair of voters given the class; a voter that
   repeats what others say counts for less. It gives posterior labels.
3. A linear classifier on word and word-part features learns those posteriors
   and scores every whole text.

The driver sees only the bounded training sample, as sets of distinct words. The
model's size is bounded too: the MAX_VOTERS strongest voters and the MAX_FEATURES
features that tell the classes apart best. Scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_text_batches, to_batch

#: At most so many labelled documents of each class are read for training.
SAMPLE_PER_CLASS = 3000
FOLDS, HELD_OUT = 5, 0
MAX_VOTERS, MIN_PRECISION = 300, 0.8
MAX_FEATURES, PENALTY = 1500, 2e-4
EM_ROUNDS, CLIMBS = 25, 250
LETTERS = re.compile(r"[^\W\d_]+")

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def words(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def parts(word: str) -> list[str]:
    """A word, and its beginnings of 3 to 7 letters."""
    return [word, *(f"^{word[:n]}" for n in range(3, min(8, len(word))))]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    voters: list[str]
    accuracy: np.ndarray
    correlation: np.ndarray

    def scorer(self):
        weights, known = self.weights, {}
        heads = {p.lstrip("^")[:3] for p in weights}

        def active(token: str) -> tuple[str, ...]:
            if len(known) > 400_000:
                known.clear()
            known[token] = f = tuple(p for w in LETTERS.findall(token) if w[:3] in heads for p in parts(w) if p in weights)
            return f

        def score(text: str | None) -> float:
            on: set[str] = set()
            for token in set((text or "").lower().split()):
                if f := known[token] if token in known else active(token):
                    on.update(f)
            return float(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[p] for p in sorted(on)), -40, 40))))

        return score


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, each voter's (rate if clean, rate if toxic), pairwise correlations.

    votes: rows x voters, 0 or 1; the last column is the label. Classes are
    told apart by starting from the labels.
    """
    posterior, sound = labels * 0.9 + 0.05, votes.astype(np.float64)
    share, rates, corr = np.ones(votes.shape[1]), None, np.eye(votes.shape[1])
    for step in range(EM_ROUNDS):
        p = posterior * weight, (1 - posterior) * weight
        rates = np.array([(q @ sound + 0.5) / (q.sum() + 1) for q in p[::-1]])
        prior = np.clip(p[0].sum() / weight.sum(), 1e-4, 1 - 1e-4)
        if step % 5 == 0:  # residual correlation given the class; echoes share their weight
            mean = np.outer(posterior, rates[1]) + np.outer(1 - posterior, rates[0])
            rest = (sound - mean) * np.sqrt(weight)[:, None]
            cov = rest.T @ rest
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / np.outer(scale, scale)
            share = 1 / (1 + np.maximum(corr - np.eye(len(corr)), 0).clip(0.1).sum(1) - 0.1 * len(corr))
            share = np.clip(share, 0.05, 1)
        yes = np.log(rates[1] / rates[0]) * share
        no = np.log((1 - rates[1]) / (1 - rates[0])) * share
        logit = np.log(prior / (1 - prior)) + sound @ (yes - no) + no.sum()
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, rates, corr


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of rows x features in {0, 1}, by accelerated proximal steps with an L1 penalty."""
    scale, target = (weight / weight.sum()).astype(np.float32), target.astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    top = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        top = x.T @ (scale * (x @ (top / np.linalg.norm(top))))
    step = np.float32(1 / (0.26 * np.linalg.norm(top)))
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    w[-1] = v[-1] = np.log((target @ scale + 1e-6) / ((1 - target) @ scale + 1e-6))
    for i in range(CLIMBS):
        at = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * (x.T @ ((at - target) * scale))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * PENALTY, 0)
        v, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w[:-1], float(w[-1])


class Sample:
    """Training documents as sorted arrays of feature numbers, a few bytes for each word."""

    def __init__(self):
        self.names: list[str] = []
        self.numbers: dict[str, int] = {}
        self.of_word: dict[str, np.ndarray] = {}
        self.rows: list[np.ndarray] = []
        self.labels: list[int] = []

    def number(self, part: str) -> int:
        if (n := self.numbers.get(part)) is None:
            self.numbers[part] = n = len(self.names)
            self.names.append(part)
        return n

    def add(self, distinct: list[str], label: int) -> None:
        for w in distinct:
            if w not in self.of_word:
                self.of_word[w] = np.array([self.number(p) for p in parts(w)], np.int32)
        self.rows.append(np.unique(np.concatenate([self.of_word[w] for w in distinct])) if distinct else np.zeros(0, np.int32))
        self.labels.append(label)


def train(sample: Sample, class_weight: dict[int, float]) -> Model:
    labels = np.array(sample.labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        at = labels.mean() if len(labels) else 0.0
        return Model({}, 20.0 if at else -20.0, [], np.zeros((2, 0)), np.zeros((0, 0)))
    weight, n_parts = np.array([class_weight[y] for y in sample.labels]), len(sample.names)
    counts = [np.zeros(n_parts) for _ in range(2)]
    for row, y in zip(sample.rows, sample.labels):
        counts[y][row] += 1
    clean, toxic = counts
    n1, n0 = labels.sum(), len(labels) - labels.sum()

    def xlog(k, e):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    # likelihood ratio of independence between feature and label; chance alone gives ratios up to about the limit
    p = (toxic + clean) / (n1 + n0)
    ratio = 2 * (xlog(toxic, n1 * p) + xlog(clean, n0 * p) + xlog(n1 - toxic, n1 * (1 - p)) + xlog(n0 - clean, n0 * (1 - p)))
    strong = np.flatnonzero((toxic + clean >= 3) & (ratio >= 2 * np.log(n_parts + 1)))
    ranked = sorted(strong.tolist(), key=lambda f: (-ratio[f], sample.names[f]))
    t, c = toxic * class_weight[1], clean * class_weight[0]
    known = [f for f in ranked if t[f] >= MIN_PRECISION * (t[f] + c[f])][:MAX_VOTERS]
    chosen = ranked[:MAX_FEATURES]

    def table(features: list[int], kind) -> np.ndarray:
        column = np.full(n_parts, -1)
        column[features] = np.arange(len(features))
        out = np.zeros((len(sample.rows), len(features)), kind)
        for i, row in enumerate(sample.rows):
            at = column[row]
            out[i, at[at >= 0]] = 1
        return out

    votes = table(known, np.int8)
    votes = np.hstack([votes, (votes.sum(1, keepdims=True) == 0).astype(np.int8), labels[:, None].astype(np.int8)])
    posterior, rates, corr = label_model(votes, labels, weight)
    w, bias = fit_linear(table(chosen, np.float32), posterior, weight)
    weights = {sample.names[f]: float(w[i]) for i, f in enumerate(chosen) if abs(w[i]) > 1e-3}
    return Model(weights, float(bias), [*(sample.names[f] for f in known), "none", "label"], rates, corr)


def sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("toxic", pa.int32())])
    for batch in batches:
        yield to_batch(schema, batch.column(0), [sorted(words(t)) for t in batch.column(1).to_pylist()], batch.column(2))


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside the held-out fold, at most SAMPLE_PER_CLASS of each class.

    The sample takes, for each class and each of SAMPLE_PER_CLASS hash strata,
    the document that comes first in hash order.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    strata = marked.groupBy("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PER_CLASS)).alias("stratum"))
    picked = strata.agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id"), F.count("*").alias("n")).collect()
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    found = id_text(docs).join(F.broadcast(ids), "doc_id").mapInArrow(sample_words, "doc_id long, words array<string>, toxic int")  # 2 * SAMPLE_PER_CLASS rows
    arrived = found.groupBy("doc_id", "toxic").agg(F.min("words").alias("words")).select("doc_id", "words", "toxic").toArrow()  # a doc_id that repeats is one document
    order = sorted(range(arrived.num_rows), key=lambda i: (arrived["doc_id"][i].as_py(), arrived["toxic"][i].as_py()))
    sample, total = Sample(), Counter()
    for i in order:
        sample.add(arrived["words"][i].as_py(), arrived["toxic"][i].as_py())
    for r in picked:
        total[r.toxic] += r.n
    have = Counter(sample.labels)
    return train(sample, {y: total[y] / have[y] for y in have})


def score_all(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            s = np.array([score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield to_batch(SCORED, batch.column(0), batch.column(2), s, (s >= 0.5).astype(np.int32))

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0;
    a score depends on nothing but the text. A null or empty text has the score
    of a text without known words. Without labels of both classes every score is
    that of the one class, or near 0. A null doc_id counts as not held out.
    Labels that are null or other than 0 and 1 are left out. An empty table gives
    no rows.
    """
    small_text_batches(docs.sparkSession)
    model = fit(docs, labels)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return id_text(docs).select("doc_id", "text", held).mapInArrow(score_all(model), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    small_text_batches(docs.sparkSession)
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
