"""Exact deduplication by an extendible-hash index on shared files.

1. Each input task folds its own equal texts and writes an index page entry for
   each distinct text (hash key, bytes, count, largest doc_id) to the shared
   folder, plus one thin row for each document that names its entry.
2. A histogram over the keys' leading bits drives directory doubling: a bucket
   above its capacity is split by the next bit. The capacity grows with the
   table, so the directory's size follows the number of owners, not of texts.
3. Owner tasks take consecutive buckets, which are key ranges of about equal
   load, chain entries with equal keys and compare bytes, so a hash collision
   cannot merge different texts.
4. Documents look up their entry's class; no text moves in that join.

A third of all rows with one text is one entry for each input task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, Scratch, id_text, partitions, small_text_batches, survivors, to_batch

#: An index bucket holds so many entries before it is split, or what makes SHARE buckets an owner if that is more.
BUCKET_ENTRIES, SHARE = 64, 16
#: The histogram is so many bits deeper than buckets of even load need; keys are hashes, so a bucket that is
#: overfull even there holds copies of one key, which no bit could split: they are chained like any others.
DEEPER = 4
#: Bytes of distinct text that one input task holds before it writes its entries.
FOLD_BYTES = 64 << 20

ENTRY = pa.schema([("page", pa.bool_()), ("entry", pa.int64()), ("key", pa.int64()), ("body", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64())])
CLASS = pa.schema([("entry", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ)


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page entries of a task's distinct texts, and a row for each document."""
    task = TaskContext.get()
    base, seen, held, made = (task.partitionId() if task else 0) << 36, {}, 0, 0

    def pages():
        rows = [(e, k, *x) for k, chain in seen.items() for e, *x in chain]
        for i in range(0, len(rows), 1000):
            part = list(zip(*rows[i : i + 1000]))
            yield to_batch(ENTRY, [True] * len(part[0]), *part)

    for batch in batches:
        ids, entries = batch.column(0).to_pylist(), []
        for doc_id, text in zip(ids, batch.column(1).to_pylist()):
            body = normalise(text)
            chain = seen.setdefault(xxhash.xxh64_intdigest(body) - (1 << 63), [])
            found = next((x for x in chain if x[1] == body), None)
            if found is None:
                chain.append(found := [base + made, body, 0, None])
                made, held = made + 1, held + len(body)
            found[2] += 1
            found[3] = larger(found[3], doc_id)
            entries.append(found[0])
        none = pa.nulls(len(ids))
        yield to_batch(ENTRY, [False] * len(ids), entries, none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), ids)
        if held > FOLD_BYTES:
            yield from pages()
            seen, held = {}, 0
    yield from pages()


def directory(loads: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bucket of each key prefix, and the global depth.

    Starts with one bucket. While a bucket of the deepest level is overfull the
    directory doubles, and each overfull bucket is split by its next bit.
    """
    bits = len(loads).bit_length() - 1
    local, depth = np.zeros(len(loads), np.int64), 0
    while depth < bits:
        full = loads.reshape(1 << depth, -1).sum(1) > capacity
        split = np.repeat(full, len(loads) >> depth) & (local == depth)
        if not split.any():
            break
        local[split] += 1
        depth += 1
    return (np.int64(1) << local) | (np.arange(len(loads)) >> (bits - local)), depth


def owners(bucket: np.ndarray, loads: np.ndarray, n: int) -> np.ndarray:
    """Owner of each key prefix: consecutive buckets go to one of n owners, so that loads are about even."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    before = np.cumsum(loads) - loads
    owner = before[first] * n // max(1, int(loads.sum()))
    return np.repeat(np.minimum(owner, n - 1), np.diff(np.r_[first, len(bucket)])).astype(np.int32)


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of equal keys, told apart by their bytes. Rows come sorted by key."""
    at, chain, out = None, [], []

    def classes():
        for body, n, keep, entries in chain:
            sha = hashlib.sha256(body).hexdigest()
            out.extend((e, keep, n, sha) for e in entries)

    for batch in batches:
        for key, entry, body, n, doc_id in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                classes()
                at, chain = key, []
                if len(out) >= 5000:
                    yield to_batch(CLASS, *zip(*out))
                    out = []
            same = next((x for x in chain if x[0] == body), None)
            if same is None:
                chain.append(same := [body, 0, None, []])
            same[1] += n
            same[2] = larger(same[2], doc_id)
            same[3].append(entry)
    classes()
    if out:
        yield to_batch(CLASS, *zip(*out))


def exact_dedup(docs: DataFrame, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only; a
    null text counts as an empty one. The largest doc_id of a class stays. Rows
    with a null doc_id count in group_size; they are kept only where the whole
    class has no doc_id, and then keep_id is null. Repeated rows with one doc_id
    are one document: each carries the same verdict. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    tmp, n = Scratch(spark, "exact"), partitions(spark)
    written = tmp.save(id_text(docs).mapInArrow(fold, "page boolean, entry long, key long, body binary, n long, doc_id long"), "index", "page")
    pages, rows = written.filter("page"), written.filter("not page").select("entry", "doc_id")

    entries = pages.count()
    capacity = max(bucket_entries, -(-entries // (SHARE * n)))
    bits = max(1, (entries // capacity).bit_length() + DEEPER)
    prefix = F.shiftrightunsigned("key", 64 - bits).cast("int")
    loads = np.zeros(1 << bits, np.int64)  # fewer than 2**(DEEPER + 1) * SHARE * n numbers
    for p, c in pages.groupBy(prefix.alias("prefix")).count().collect():
        loads[p] = c
    bucket, _ = directory(loads, capacity)
    table = spark.createDataFrame(pa.table({"prefix": np.arange(1 << bits, dtype=np.int32), "owner": owners(bucket, loads, n)}))
    owned = (
        pages.join(F.broadcast(table), prefix == F.col("prefix"))  # as many rows as loads, of 8 bytes
        .select("owner", "key", "entry", "body", "n", "doc_id")
        .repartitionById(n, "owner")
        .sortWithinPartitions("key")
        .select("key", "entry", "body", "n", "doc_id")
    )
    classes = tmp.save(owned.mapInArrow(own, "entry long, keep_id long, group_size long, text_sha256 string"), "classes")
    result = tmp.save(
        rows.join(classes, "entry").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
        ),
        "result",
    )
    tmp.keep("result")
    return result


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, one of each class of equal texts.

    The row with the largest doc_id stays; of repeated rows with that doc_id, or
    of a class without any doc_id, the first in hash order.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256)
    return survivors(docs, exact_dedup(docs), ["text_sha256"], lambda rows: rows.withColumn("text_sha256", sha))
