"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt to ranges of doc_id and sorted, and each range's task encodes
its texts and writes one file: a row for each document, with its token ids and
its place in the file's stream. Places of whole files add up from their totals,
so no task counts all tokens. ORC keeps ids by run-length encoded integers, and
for every INDEX_ROWS rows the least and largest doc_id and a Bloom filter of
them: a reader that asks for documents by id skips stripes and row groups by
these alone, and a scan deals stripes to tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, id_text, partitions, small_text_batches, worker_cache
from .packing import END_ID, encoder, special_tokens

INDEX_ROWS, STRIPE_BYTES, FALSE_HITS = 1000, 16 << 20, 0.01
ORC = {
    "compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": str(INDEX_ROWS), "orc.stripe.size": str(STRIPE_BYTES),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_HITS),
}

#: `part` numbers the files in their order, `place` counts the ids of the file before the document.
FILE = "doc_id long, part int, place long, n_tokens long, ids array<int>"
ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
READ = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode(json_path: str, ranks_path: str, end_id: int):
    special = special_tokens(json_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(("encoder", json_path), lambda: encoder(json_path, ranks_path, special))
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [np.append(encode(t) if t else np.zeros(0, np.int32), end_id).astype(np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            listed = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(ids))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, part), pa.int32()), pa.array(place + ends[:-1]), pa.array(np.diff(ends)), listed], schema=ROWS)
            place += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, json_path: str | None = None, ranks_path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of every text of docs(doc_id, text), and end_id after each, in ascending order of doc_id.

    A null or empty text is end_id alone. A null doc_id comes first. Rows that
    share a doc_id follow each other by a hash of their texts; equal rows, of which
    there may be very many, are still dealt to several files. An empty table
    writes files without rows.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    keys = ["doc_id", "order", "origin"]
    rows = id_text(docs).withColumns({"order": F.xxhash64("text"), "origin": F.spark_partition_id()})
    ranged = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    run = encode(json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id)
    ranged.mapInArrow(run, FILE).write.mode("overwrite").options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows, or those of a few documents, for which other stripes and row groups are skipped by their index."""
    rows = spark.read.schema(FILE).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def file_starts(rows: DataFrame) -> DataFrame:
    """(part, before): the ids of all files before each; a row for each file, from three scalar columns."""
    totals = rows.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as files
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("before"))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of ids of each row and their CRC-32 as little-endian unsigned 32-bit integers."""
    for batch in batches:
        ids = batch.column(3)
        ends = ids.offsets.to_numpy().astype(np.int64)
        body = memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
        sums = [zlib.crc32(body[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends)), pa.array(sums, pa.int64())], schema=READ)


def described(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    rows = read_tokens(spark, path)
    read = rows.select("doc_id", "part", "place", "ids").mapInArrow(checksums, "doc_id long, part int, place long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(file_starts(rows)), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")  # a row for each file


def token_files(docs: DataFrame) -> DataFrame:
    """write_tokens() to the shared folder, and described() of what was written; an empty table gives no rows."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "tokens")
    path = f"{tmp.root}/files"
    write_tokens(docs, path)
    result = tmp.save(described(spark, path), "result")
    tmp.keep("result")
    return result
