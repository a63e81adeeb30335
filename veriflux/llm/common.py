"""Shared storage, Arrow helpers and hashing used by the training-data operators."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, shared_dir  # noqa: F401  for the operators

#: Rows in one Arrow batch of whole texts; keeps a batch of long texts small.
TEXT_BATCH_ROWS = 1000

#: A bitmap of ids has so many words of 64 bits at least and at most: 1 << 18 of them are 3 MB to broadcast.
FEWEST_WORDS, MOST_WORDS = 1 << 10, 1 << 18

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def small_text_batches(spark: SparkSession) -> None:
    """Whole texts travel in batches of few rows; one long text costs no more than itself."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text by name; other columns of the input cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def likely(rows: DataFrame, ids: DataFrame, name: str = "likely") -> DataFrame:
    """rows with a boolean: false only where their doc_id, null included, is not among ids(doc_id).

    A bitmap of hashes, of at most MOST_WORDS words, goes to all tasks, so that
    a join afterwards need not shuffle texts that it would drop.
    """
    words = min(MOST_WORDS, max(FEWEST_WORDS, 1 << (ids.count() // 4).bit_length()))  # some 16 bits an id
    hashed = F.xxhash64("doc_id")
    word, bit = F.pmod(F.shiftright(hashed, 6), F.lit(words)).cast("int"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")
    bitmap = ids.select(word.alias("word__"), bit.alias("bit__")).groupBy("word__").agg(F.bit_or("bit__").alias("bits__"))
    marked = rows.withColumn("at__", word).join(F.broadcast(bitmap), F.col("at__") == F.col("word__"), "left")  # at most MOST_WORDS rows of 12 bytes
    return marked.select(*rows.columns, (F.coalesce("bits__", F.lit(0).cast("long")).bitwiseAND(bit) != 0).alias(name))


def survivors(docs: DataFrame, verdicts: DataFrame, keys: list[str], keyed) -> DataFrame:
    """The rows of docs that verdicts(doc_id, kept, *keys) keep, one of those with equal doc_id and keys.

    A doc_id that stands once is looked up by itself. Rows whose doc_id repeats or
    is null need their keys again: keyed(rows) adds them to (row, doc_id, text).
    Of several equal ones the row that comes first in hash order stays.
    """
    counted = verdicts.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("kept"))
    once = counted.where("n = 1 and kept = 1 and doc_id is not null").select(F.col("doc_id").alias("kept_id"))
    out = docs.join(once, docs["doc_id"].cast("long") == once["kept_id"], "left_semi")
    again = counted.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("again_id"))
    if not again.limit(1).count():
        return out
    several = docs.join(again, docs["doc_id"].cast("long") == again["again_id"], "left_semi").union(docs.where("doc_id is null"))
    rows = keyed(several.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    kept = verdicts.where("kept").select(F.col("doc_id").alias("kept_id"), *[F.col(k).alias(f"kept_{k}") for k in keys])
    same = rows["doc_id"].eqNullSafe(kept["kept_id"])
    for k in keys:
        same = same & rows[k].eqNullSafe(kept[f"kept_{k}"])
    order = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
    chosen = rows.join(kept, same, "left_semi").groupBy("doc_id", *keys).agg(F.min_by("row", order).alias("row"))
    return out.union(chosen.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def worker_cache(key, build):
    """A value built once in each Python worker process, kept between tasks."""
    kept = sys.modules.setdefault("_veriflux_worker_cache", types.ModuleType("_veriflux_worker_cache"))
    if key not in kept.__dict__:
        kept.__dict__[key] = build()
    return kept.__dict__[key]


def to_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def spread(buckets: np.ndarray, columns: list[np.ndarray]):
    """(bucket, columns' bytes) for each bucket that occurs: one shuffled row for many small ones."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, int)
    columns = [c[order] for c in columns]
    for i, s in enumerate(starts):
        e = starts[i + 1] if i + 1 < len(starts) else len(sorted_)
        yield int(sorted_[s]), [c[s:e].tobytes() for c in columns]
