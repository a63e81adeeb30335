"""Word n-gram classifier: TF-IDF features and a balanced logistic regression.

Texts are cut into grams once. What is kept is a table of gram hashes and counts
for each row; the vocabulary, the document frequencies, the features of the fit
and all scores come from that table. Grams are told apart by 64 hash bits.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import Scratch

TOKEN = re.compile(r"\b\w\w+\b")
#: The most steps of the fit, and the rarest gram that counts.
MAX_ITERATIONS, MIN_DOCUMENTS = 1000, 2
ODD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower case without accents: compatibility forms are taken apart and combining marks dropped."""
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


class Hashes(dict):
    """Hashes of tokens, each computed once."""

    def __missing__(self, token: str) -> int:
        self[token] = found = int.from_bytes(blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return found


def grams_of(text: str, max_n: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct 1..max_n-grams, and how often each occurs."""
    tokens = TOKEN.findall(plain(text))
    one = np.fromiter((hashes[t] for t in tokens), np.uint64, len(tokens))
    parts, run = [one], one
    for n in range(1, max_n):
        run = stirred(run[:-1] * ODD + one[n:]) if len(run) > 1 else one[:0]
        parts.append(run)
    return np.unique(np.concatenate(parts).view(np.int64), return_counts=True)


def cut(max_n: int):
    """Replaces the last column, a text, by its grams and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = [grams_of(t or "", max_n, hashes) for t in batch.column(batch.num_columns - 1).to_pylist()]
            if len(hashes) > 1_000_000:
                hashes.clear()
            ends = pa.array(np.cumsum([0, *(len(g) for g, _ in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if found else [], kind)) for x, kind in zip(zip(*found), (pa.int64(), pa.int32()))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "grams", "counts"])

    return run


def gram_table(rows: DataFrame, max_n: int, tmp: Scratch, name: str) -> DataFrame:
    """rows with `grams` and `counts` in place of `text`, written."""
    kept = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return tmp.save(rows.select(*kept, "text").mapInArrow(cut(max_n), schema), name)


def weighing(vocabulary: np.ndarray, idf: np.ndarray):
    """Unit vectors of (1 + ln count) * idf over the vocabulary, in place of the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, counts = batch.columns[-2:]
            ends, g = grams.offsets.to_numpy(), grams.values.to_numpy()
            at = np.minimum(np.searchsorted(vocabulary, g), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == g if len(vocabulary) else np.zeros(len(g), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))[known]
            at = at[known]
            value = (1 + np.log(counts.values.to_numpy()[known])) * idf[at]
            norm = np.sqrt(np.bincount(row, value * value, batch.num_rows))
            places = pa.array(np.cumsum([0, *np.bincount(row, minlength=batch.num_rows)]), pa.int32())
            n = batch.num_rows
            vectors = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(vocabulary), np.int32)), pa.ListArray.from_arrays(places, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(places, pa.array(value / np.where(norm[row] > 0, norm[row], 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.StructArray.from_arrays(vectors, ["type", "size", "indices", "values"])], names=[*batch.schema.names[:-2], "features"])

    return run


class TfIdf:
    """Word 1..max_n-grams, 1 + ln of counts, smooth idf ln((n + 1) / (df + 1)) + 1, unit length, balanced logistic regression.

    The vocabulary has the `vocabulary` most frequent grams of MIN_DOCUMENTS or
    more documents, ties by hash; it is what reaches the driver.
    """

    def __init__(self, train: DataFrame, max_n: int = 3, vocabulary: int = 50_000, tmp: Scratch | None = None):
        """train has label and either text, or what gram_table() makes of it."""
        self.max_n, self.tmp = max_n, tmp or Scratch(train.sparkSession, "grams")
        table = self.table(train, "train")
        sizes = {r.label: r["count"] for r in table.groupBy("label").count().collect()}  # a row for each class
        n = sum(sizes.values())
        pairs = table.select(F.explode(F.arrays_zip("grams", "counts")).alias("g"))
        totals = pairs.groupBy("g.grams").agg(F.count("*").alias("df"), F.sum("g.counts").alias("total")).where(F.col("df") >= MIN_DOCUMENTS)
        top = totals.orderBy(F.desc("total"), "grams").limit(vocabulary).collect()
        found = np.array(sorted((r.grams, r.df) for r in top), np.int64).reshape(-1, 2)
        self.vocabulary, self.idf = found[:, 0].copy(), np.log((n + 1) / (found[:, 1] + 1)) + 1
        weight = F.lit(None).cast("double")
        for label, size in sizes.items():
            weight = F.when(F.col("label") == label, n / (len(sizes) * size)).otherwise(weight)
        fit = LogisticRegression(regParam=1.0 / max(1, n), weightCol="weight", maxIter=MAX_ITERATIONS)
        self.model = fit.fit(self.features(table.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "grams", "counts")))

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        return rows if "grams" in rows.columns else gram_table(rows, self.max_n, self.tmp, name)

    def features(self, table: DataFrame) -> DataFrame:
        kept = [c for c in table.columns if c not in ("grams", "counts")]
        schema = T.StructType([*[table.schema[c] for c in kept], T.StructField("features", VectorUDT())])
        return table.select(*kept, "grams", "counts").mapInArrow(weighing(self.vocabulary, self.idf), schema)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows without their texts, with rawPrediction, probability and prediction."""
        return self.model.transform(self.features(self.table(rows, "scored"))).drop("features")

    def save(self, path: str, metrics: dict | None = None) -> None:
        """The model, its vocabulary and, as JSON, its metrics."""
        spark: SparkSession = self.tmp.spark
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame(list(zip(self.vocabulary.tolist(), self.idf.tolist())), "gram long, idf double").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        told = json.dumps({"max_n": self.max_n, "vocabulary": len(self.vocabulary), **(metrics or {})}, sort_keys=True)
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfIdf:
        self = cls.__new__(cls)
        found = spark.read.parquet(f"{path}/vocabulary").orderBy("gram").collect()
        self.vocabulary, self.idf = np.array([r.gram for r in found], np.int64), np.array([r.idf for r in found])
        self.max_n, self.tmp = json.loads(spark.read.text(f"{path}/metrics").first().value)["max_n"], Scratch(spark, "grams")
        self.model = LogisticRegressionModel.load(f"{path}/model")
        return self
