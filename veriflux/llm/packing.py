"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are tokenised once; pieces (never their ids) go to the shared folder.
Only the histogram of piece lengths reaches the driver, at most `length` rows.
There, lengths are placed longest first, each into the pattern with the most
room, by counts; patterns and pieces meet again by a piece's rank within its
length. Ranks come from counts of each task and length, so no task numbers all
pieces of a frequent length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, id_text, small_text_batches, to_batch, worker_cache

SEQUENCE = 1024
END_ID = 0

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("local", pa.int64())])
PLACED = pa.schema([*list(PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def special_tokens(json_path: str) -> list[str]:
    from tokenizers import Tokenizer

    return [t.content for t in Tokenizer.from_file(json_path).get_added_tokens_decoder().values()]


def encoder(json_path: str, ranks_path: str, special: list[str]):
    """text -> token ids of the tokenizer in json_path.

    Texts of Latin letters and common punctuation go through the same
    vocabulary's rank file, five times as fast with equal ids; any other text,
    and one that spells a special token, through the tokenizer file itself,
    which a worker that meets no such text never loads.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast, exact = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), []
    del ranks

    def encode(text: str) -> np.ndarray:
        if (text.isascii() or max(text) < "ɐ") and not any(s in text for s in special):
            return fast.encode_to_numpy(text, disallowed_special=())
        if not exact:
            from tokenizers import Tokenizer

            exact.append(Tokenizer.from_file(json_path))
        return np.array(exact[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenise(json_path: str, ranks_path: str, length: int, end_id: int):
    special = special_tokens(json_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_cache(("encoder", json_path), lambda: encoder(json_path, ranks_path, special))
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode((text or "").encode("utf-8", "replace").decode()), end_id).astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start : start + length]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), task, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            if rows:
                yield to_batch(PIECE, *zip(*rows))

    return run


def shortest_pack_first(counts: np.ndarray, length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, piece lengths) patterns for counts[n] pieces of each length n below length."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    most = 0
    for n in range(length - 1, 0, -1):
        left, put = int(counts[n]), []
        while left:
            while most >= n and not room.get(most):
                most -= 1
            if most < n:  # new packs; the shortest pack that fits is then the newest one
                fit = length // n
                for packs, pieces in ((left // fit, fit), (1, left % fit)):
                    if packs and pieces:
                        put.append((length - pieces * n, packs, (n,) * pieces))
                break
            have, pattern = room[most].pop()
            used = min(have, left)
            if have > used:
                room[most].append((have - used, pattern))
            put.append((most - n, used, (*pattern, n)))
            left -= used
            if most - n >= n:  # the fuller pattern may still be the shortest one
                space, used, pattern = put.pop()
                room.setdefault(space, []).append((used, pattern))
        for space, used, pattern in put:
            room.setdefault(space, []).append((used, pattern))
            most = max(most, space)
    return [x for space in sorted(room) for x in room[space]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, sequence of that rank, offset) sorted by length and rank; number of sequences.

    Each length opens at most two patterns and splits at most one more, whatever
    the number of documents, so there are fewer than three patterns a length.
    """
    rows, used, at = [], {}, 0
    for count, pattern in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), at, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        at += count
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))], at


def assign(table: np.ndarray, n_packed: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            n, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            full = n == length
            at = np.maximum(np.searchsorted(key, n << 44 | rank, "right") - 1, 0)
            row = table[at] if len(table) else np.zeros((len(n), 4), np.int64)
            sequence = np.where(full, n_packed + rank, row[:, 2] + rank - row[:, 1])
            yield to_batch(PLACED, *batch.columns[:5], sequence, np.where(full, 0, row[:, 3]))

    return run


def pack(docs: DataFrame, length: int = SEQUENCE, json_path: str | None = None, ranks_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    A document is its text's ids and end_id (a null or empty text: end_id alone).
    Pieces are cut at multiples of `length`; a full piece is a sequence, shorter
    ones share sequences without gaps. Repeated rows and null doc_ids are packed
    like any other row. Lone surrogates count as "?". An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    tmp = Scratch(spark, "packing")
    run = tokenise(json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), length, end_id)
    pieces = tmp.save(id_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, local long"), "pieces")
    by_task = tmp.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task")
    counts = np.zeros(length + 1, np.int64)
    for n, c in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most `length` rows
        counts[n] = c
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = tmp.save(by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    table, n_packed = slots(shortest_pack_first(counts, length))
    ranked = pieces.join(first, ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local")).alias("rank"))
    result = tmp.save(ranked.mapInArrow(assign(table, n_packed, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), "result")
    tmp.keep("result")
    return result
