"""Removal of repeated 50-byte passages by phrases around rolling-hash triggers, in the manner of prefix-free parsing.

A rolling hash of TRIGGER bytes places triggers: a position is one where its
hash is the least of some window of SPAN - TRIGGER + 1 positions. So every
SPAN-byte string holds a trigger, and equal strings hold the same ones. A trigger
ends a left phrase and begins a right one, which overlap in it, as phrases of a
prefix-free parse do; they reach SPAN - TRIGGER bytes beyond it, which is all
that the strings through this trigger can touch, and not to the next trigger.

The parse lists the phrase pairs of each document by trigger; the dictionary
holds distinct phrases. There is no order of the whole corpus: strings through
different triggers differ, so each owner of triggers orders what it has by itself.
1. parse: owner tasks take ranges of trigger hashes. A pair that a smaller
   document has too is repeated throughout, and needs no bytes.
2. dictionary: only a document's pairs whose trigger also stands in a different
   pair of another document go on. Owner tasks sort their left phrases, read
   backwards, and their right ones. A SPAN-byte string is a left phrase's suffix
   and a right phrase's prefix, hence a pair of classes in these two orders;
   in a class pair, all but the smallest document's strings are repeated.
3. Documents merge what is repeated and drop it.

A pair that a third of all documents share is sent once for each batch of input.
A trigger that stands in very many different pairs is not sent to one owner at
all: its strings are, each by its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text, mix64, partitions, small_text_batches, spread, to_batch

SPAN, TRIGGER = 50, 20
AROUND = SPAN - TRIGGER
PHRASE = TRIGGER + 2 * AROUND
#: Phrase pairs that an owner task sorts at once; strings that are equal share a trigger, whose pairs stay together.
SORTED = 100_000
#: Triggers with so many different pairs in a sample of one document in SAMPLED (by hash) have their strings sent one by one.
#: Such triggers are marked in a bitmap of HOT_BITS, and others that share their bits go the same way: this decides where
#: strings meet, not which.
SAMPLED, MANY, HOT_BITS = 64, 400, 1 << 22

BASE = 0x9E3779B97F4A7C15
PARSED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
FOUND = pa.schema([("doc_bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
LISTED = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary()), ("open", pa.binary())])
DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
WAITING = pa.schema([*DONE, ("body", pa.binary()), ("spans", pa.binary()), ("open", pa.binary())])


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def doubled(x: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of 1, 2, 4, ... bytes."""
    out, n = {1: x}, 1
    while 2 * n <= longest:
        out[2 * n] = out[n][:-n] * power(n) + out[n][n:]
        n *= 2
    return out


def least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: -(width - n)], h[width - n :]) if width > n else h


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as asked for so far."""

    def __init__(self, base: int):
        self.base, self.known = base, (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            size = 1 << (n - 1).bit_length()
            factors = np.full((2, size), 1, np.uint64)
            factors[0, 1:], factors[1, 1:] = self.base, pow(self.base, -1, 1 << 64)
            self.known = tuple(np.cumprod(factors, axis=1))
        return self.known[0][:n], self.known[1][:n]


SECOND = Powers(0xC2B2AE3D27D4EB4F)


def spans_hash(x: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A second hash, of another base, of the strings of x at start."""
    up, down = SECOND(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[1:], out=sums[1:])
    return mix64((sums[start + length] - sums[start]) * down[start])


def triggers(body: bytes):
    """Positions of a document's triggers, their hashes, two hashes of their phrase pairs, and the padded bytes with h[64] and h[16]."""
    if len(body) < SPAN:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none, none, None
    x = np.zeros(len(body) + 2 * AROUND, np.uint64)  # zeros stand for what is beyond the document
    x[AROUND:-AROUND] = np.frombuffer(body, np.uint8)
    x[AROUND:-AROUND] += np.uint64(1)
    h = doubled(x, 64)
    own = mix64(h[16][AROUND:-AROUND][: len(body) - TRIGGER + 1] * power(4) + h[4][AROUND + 16 : AROUND + 16 + len(body) - TRIGGER + 1])
    width = SPAN - TRIGGER + 1
    top = np.full(len(own) + width - 1, 0, np.uint64)
    lows = least(own, width)
    # a trigger is a position that equals the minimum of a window around it: the largest of those minima
    top = ~least(~np.concatenate([np.zeros(width - 1, np.uint64), lows, np.zeros(width - 1, np.uint64)]), width)
    at = np.flatnonzero(own == top)
    phrase = mix64(h[64][at] * power(16) + h[16][at + 64])
    return at, own[at], phrase, spans_hash(x, at, PHRASE), (x, h)


def windows(found, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two hashes of each distinct SPAN-byte string through the triggers at these positions of a document."""
    start = np.unique(at[:, None] - np.arange(AROUND + 1))
    start = start[(start >= 0) & (start + SPAN <= size)]
    x, h = found
    p = start + AROUND  # in the padded bytes
    first = mix64((h[32][p] * power(16) + h[16][p + 32]) * power(2) + h[2][p + 48])
    return start, first, spans_hash(x, p, SPAN)


def cut(values: np.ndarray, n: int) -> np.ndarray:
    """The leading n bytes of each value."""
    return np.ascontiguousarray((values >> np.uint64(64 - 8 * n)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def uncut(body: bytes, n: int, rows: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :n] = np.frombuffer(body, np.uint8).reshape(rows, n)
    return out.view("<u8").ravel()


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal intervals of a union; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return start[new], end[np.r_[new[1:] - 1, len(end) - 1]]


def merged_by_doc(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """merged() within each document."""
    if not len(doc):
        return doc, start, end
    ids, at = np.unique(doc, return_inverse=True)
    far = np.int64(end.max() + 2)
    s, e = merged(at * far + start, at * far + end)
    return ids[s // far], s % far, e - (s // far) * far


def repeated(h, phrase, second, doc):
    """For rows: whether a smaller document has the same phrase pair, and whether the trigger needs the dictionary."""
    order = np.lexsort((doc, second, phrase, h))
    h, phrase, second, doc = h[order], phrase[order], second[order], doc[order]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_p = new_h | np.r_[True, (phrase[1:] != phrase[:-1]) | (second[1:] != second[:-1])]
    h_run, p_run = np.cumsum(new_h) - 1, np.cumsum(new_p) - 1
    first = doc[np.flatnonzero(new_p)][p_run]
    low, high = np.minimum.reduceat(doc, np.flatnonzero(new_h)), np.maximum.reduceat(doc, np.flatnonzero(new_h))
    mixed = (np.bincount(h_run, new_p) > 1) & (low != high)
    again, open_ = np.empty(len(doc), bool), np.empty(len(doc), bool)
    again[order] = doc > first
    open_[order] = mixed[h_run] & (doc == first)
    return again, open_


def doubles(h: np.ndarray) -> np.ndarray:
    """Rows whose value occurs more than once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def many_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triggers and hashes of their distinct phrase pairs, for each text."""
    schema = pa.schema([("trigger", pa.int64()), ("pair", pa.int64())])
    for batch in batches:
        for text in batch.column(0).to_pylist():
            _, own, phrase, _, _ = triggers((text or "").encode("utf-8", "surrogatepass"))
            yield to_batch(schema, own.view(np.int64), phrase.view(np.int64))


def hot_triggers(texts: DataFrame) -> np.ndarray:
    """A bitmap of triggers with very many different phrase pairs, as words of 64 bits; empty where there are none."""
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text")
    pairs = some.mapInArrow(many_pairs, "trigger long, pair long").groupBy("trigger", "pair").agg(F.lit(1).alias("one"))
    found = pairs.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") >= MANY).withColumn("bit", F.pmod("trigger", F.lit(HOT_BITS)))
    words = found.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    rows = words.collect()  # at most HOT_BITS / 64 rows
    bitmap = np.zeros(HOT_BITS // 64 if rows else 0, np.int64)
    for r in rows:
        bitmap[r.word] = r.bits
    return bitmap.view(np.uint64)


def is_hot(bitmap: np.ndarray, own: np.ndarray) -> np.ndarray:
    bit = own % np.uint64(HOT_BITS)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def parse(n_buckets: int, n_settled: int, hot: np.ndarray):
    """Phrase pairs of each batch for the owners of their triggers (kind 0), spans settled within the batch (kind 1), strings of hot triggers (kind 2)."""

    def sent_pairs(doc, at, h, phrase, second, settled):
        """What of the batch's rows goes to owners; a row that a smaller document of the batch repeats is settled."""
        sent = np.ones(len(at), bool)
        two = np.flatnonzero(doubles(h))
        if len(two):
            again, _ = repeated(h[two], phrase[two], second[two], doc[two])
            sent[two[again]] = False
            settled.append((doc[two[again]], at[two[again]]))
        return [x[sent] for x in (doc, at.astype(np.int32), h, phrase, second)]

    def rows(kind, n, key, columns):
        for bucket, blobs in spread((key % np.uint64(n)).astype(np.int32), columns):
            yield to_batch(PARSED, [bucket], [kind], [np.int32(len(blobs[-1]) // 4).tobytes() + b"".join(blobs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, strings = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None or not text:
                    continue
                body = text.encode("utf-8", "surrogatepass")
                at, own, phrase, second, found = triggers(body)
                if len(hot) and len(at):
                    spread_out = is_hot(hot, own)
                    if spread_out.any():
                        start, *hashes = windows(found, at[spread_out], len(body))
                        strings.append((np.full(len(start), doc_id, np.int64), start, *hashes))
                        at, own, phrase, second = (v[~spread_out] for v in (at, own, phrase, second))
                pairs.append((np.full(len(at), doc_id, np.int64), at, own, phrase, second))
            settled = []
            if pairs:
                doc, at, h, phrase, second = sent_pairs(*(np.concatenate(x) for x in zip(*pairs)), settled)
                yield from rows(0, n_buckets, h, [cut(h, 5), cut(phrase, 8), cut(second, 4), doc, at])
            spans = [(d, np.maximum(a - AROUND, 0), a + SPAN) for d, a in settled]
            if strings:
                settled, (doc, start, one, two) = [], (np.concatenate(x) for x in zip(*strings))
                doc, start, one, two, _ = sent_pairs(doc, start, one, two, np.zeros(len(doc), np.uint64), settled)
                yield from rows(2, n_buckets, one, [one, cut(two, 4), doc, start])
                spans += [(d, a, a + SPAN) for d, a in settled]
            if spans:
                d, s, e = merged_by_doc(*(np.concatenate(x) for x in zip(*spans)))
                yield from rows(1, n_settled, mix64(d.view(np.uint64)), [d, s.astype(np.int32), e.astype(np.int32)])

    return run


def to_docs(n_buckets: int, kind: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    for bucket, blobs in spread((mix64(doc.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), [doc, start.astype(np.int32), end.astype(np.int32)]):
        yield to_batch(FOUND, [bucket], [kind], *[[b] for b in blobs])


def own_parse(n_buckets: int):
    """Spans that are repeated (kind 1) and triggers that need the dictionary (kind 2; start: the trigger, end: its hash)."""

    def columns(view, n, widths):
        at = 0
        for width in widths:
            yield view[at * n : (at + width) * n]
            at += width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, strings, settled = [], [], []
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, view = int.from_bytes(body[:4], "little"), memoryview(body)[4:]
                if kind == 1:
                    d, s, e = columns(view, n, (8, 4, 4))
                    settled.append((np.frombuffer(d, np.int64), np.frombuffer(s, np.int32), np.frombuffer(e, np.int32)))
                elif kind == 2:
                    one, two, doc, start = columns(view, n, (8, 4, 8, 4))
                    strings.append((np.frombuffer(one, np.uint64), uncut(two, 4, n), np.frombuffer(doc, np.int64), np.frombuffer(start, np.int32)))
                else:
                    h, phrase, second, doc, at = columns(view, n, (5, 8, 4, 8, 4))
                    pairs.append((uncut(h, 5, n), np.frombuffer(phrase, np.uint64), uncut(second, 4, n), np.frombuffer(doc, np.int64), np.frombuffer(at, np.int32)))
        if pairs:
            h, phrase, second, doc, at = (np.concatenate(x) for x in zip(*pairs))
            pairs.clear()
            two = doubles(h)
            h, phrase, second, doc, at = h[two], phrase[two], second[two], doc[two], at[two].astype(np.int64)
            if len(h):
                again, open_ = repeated(h, phrase, second, doc)
                settled.append((doc[again], np.maximum(at[again] - AROUND, 0), at[again] + SPAN))
                # 31 bits of the hash bring equal triggers together again
                yield from to_docs(n_buckets, 2, doc[open_], at[open_], (h[open_] & np.uint64(0x7FFFFFFF)).astype(np.int64))
        if strings:
            one, two, doc, start = (np.concatenate(x) for x in zip(*strings))
            strings.clear()
            again, _ = repeated(one, two, np.zeros(len(doc), np.uint64), doc)
            settled.append((doc[again], start[again].astype(np.int64), start[again].astype(np.int64) + SPAN))
        if settled:
            d, s, e = (np.concatenate(x) for x in zip(*settled))
            yield from to_docs(n_buckets, 1, *merged_by_doc(d, s.astype(np.int64), e.astype(np.int64)))

    return run


def list_by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its merged spans, and its open triggers with their hashes."""
    parts = {1: [], 2: []}
    for batch in batches:
        for kind, *blobs in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            parts[kind].append((np.frombuffer(blobs[0], np.int64), np.frombuffer(blobs[1], np.int32), np.frombuffer(blobs[2], np.int32)))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    doc, start, end = (np.concatenate(x) for x in zip(empty, *parts[1]))
    spans = merged_by_doc(doc, start.astype(np.int64), end.astype(np.int64))
    doc, start, end = (np.concatenate(x) for x in zip(empty, *parts[2]))
    order = np.lexsort((start, doc))
    opened = doc[order], start[order], end[order]

    def rows(doc, a, b):
        ids, first = np.unique(doc, return_index=True)
        pairs = np.stack([a, b], 1).astype(np.int32)
        return {int(i): pairs[s:e].tobytes() for i, s, e in zip(ids, first, [*first[1:], len(doc)])}

    spans, opened = rows(*spans), rows(*opened)
    ids = sorted(spans.keys() | opened.keys())
    for i in range(0, len(ids), 2000):
        part = ids[i : i + 2000]
        yield to_batch(LISTED, part, [spans.get(d, b"") for d in part], [opened.get(d, b"") for d in part])


def without(doc_id, body: bytes, spans: bytes):
    """The result row of a document from its spans."""
    pairs = np.frombuffer(spans, np.int32).reshape(-1, 2).astype(np.int64)
    pairs = np.minimum(pairs[pairs[:, 0] < len(body)], len(body))  # a longer text with the same doc_id may have given some
    start, end = merged(pairs[:, 0], pairs[:, 1])
    sha, kept = hashlib.sha256(), 0
    for s, e in zip(start.tolist(), end.tolist()):
        sha.update(body[kept:s])
        kept = e
    sha.update(body[kept:])
    return doc_id, len(body), int((end - start).sum()), len(start), sha.hexdigest()


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows; documents with open triggers keep their bytes and wait."""
    for batch in batches:
        rows = []
        for doc_id, text, spans, opened in zip(*(c.to_pylist() for c in batch.columns)):
            body = (text or "").encode("utf-8", "surrogatepass")
            if opened:
                rows.append((doc_id, None, None, None, None, body, spans, opened))
            else:
                rows.append((*without(doc_id, body, spans or b""), None, None, None))
        if rows:
            yield to_batch(WAITING, *zip(*rows))


def dictionary(n_buckets: int):
    """Phrases of open triggers, by the trigger's hash: rows of PHRASE bytes, document, position, length of what precedes and follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, ats, sizes, bodies = [], [], [], [], []
            for doc_id, body, opened in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = np.frombuffer(opened, np.int32).reshape(-1, 2)
                pairs = pairs[pairs[:, 0] + TRIGGER <= len(body)]  # another text with the same doc_id may be longer
                padded = np.zeros(len(body) + 2 * AROUND, np.uint8)
                padded[AROUND:-AROUND] = np.frombuffer(body, np.uint8)
                at = pairs[:, 0].astype(np.int64)
                bodies.append(padded[at[:, None] + np.arange(PHRASE)])
                hs.append(pairs[:, 1].astype(np.int64))
                ids.append(np.full(len(at), doc_id, np.int64))
                ats.append(at.astype(np.int32))
                sizes.append(np.full(len(at), len(body), np.int32))
            if not ids:
                continue
            h = np.concatenate(hs)
            columns = [h, np.concatenate(ids), np.concatenate(ats), np.concatenate(sizes), np.concatenate(bodies)]
            for bucket, blobs in spread((h % n_buckets).astype(np.int32), columns):
                yield to_batch(PARSED, [bucket], [len(blobs[0]) // 8], [b"".join(blobs)])

    return run


def classes(h: np.ndarray, body: np.ndarray) -> np.ndarray:
    """(AROUND + 1, rows): for n = 0 .. AROUND, a number for each row that is equal where h and the first n bytes are.

    Rows are sorted once by h and their bytes; from how many bytes neighbours
    share follow the classes of all lengths.
    """
    keyed = np.zeros((len(h), 8 + AROUND), np.uint8)
    keyed[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    keyed[:, 8:] = body
    flat = np.ascontiguousarray(keyed).view(f"V{8 + AROUND}").ravel()
    order = np.argsort(flat, kind="stable")
    sorted_ = keyed[order]
    differ = sorted_[1:] != sorted_[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), 8 + AROUND)  # bytes that neighbours share, h's among them
    out = np.zeros((AROUND + 1, len(h)), np.int64)
    for n in range(AROUND + 1):
        out[n, order[1:]] = np.cumsum(shared < 8 + n)
    return out


def suffixes(h, doc, at, size, body):
    """Repeated spans (doc, start, end) among the SPAN-byte strings through triggers, from the orders of their phrases."""
    # a string through the trigger holds the 15 bytes before it, or the 15 after: pairs that share neither with another document are done
    half = AROUND // 2
    near = np.zeros(len(h), bool)
    for lo, hi in ((half, half + TRIGGER + half), (AROUND, AROUND + TRIGGER + half)):
        part = np.zeros((len(h), 8), np.uint64)
        part.view(np.uint8).reshape(len(h), 64)[:, : hi - lo] = body[:, lo:hi]
        key = h.astype(np.uint64)
        for i in range(8):
            key = mix64(key * np.uint64(BASE) + part[:, i])
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        run = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
        near[order] |= (np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin))[run]
    h, doc, at, size, body = (x[near] for x in (h, doc, at, size, body))
    out = []
    order = np.argsort(h, kind="stable")
    h, doc, at, size, body = (x[order] for x in (h, doc, at, size, body))
    ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1 if len(h) else []
    lo = 0
    for k, hi in enumerate(ends):
        if hi - lo < SORTED and k + 1 < len(ends):
            continue
        d, a, part = doc[lo:hi], at[lo:hi].astype(np.int64), body[lo:hi]
        # the trigger's own bytes stand in its class; its hash could be another's
        trigger = np.unique(part[:, AROUND : AROUND + TRIGGER].copy().view(f"V{TRIGGER}").ravel(), return_inverse=True)[1]
        left = classes(trigger, part[:, AROUND - 1 :: -1])
        right = classes(trigger, part[:, AROUND + TRIGGER :])
        for n in range(AROUND + 1):  # strings with n bytes before the trigger
            start = a - n
            real = np.flatnonzero((start >= 0) & (start + SPAN <= size[lo:hi]))
            pair = left[n, real] * np.int64(hi - lo + 1) + right[AROUND - n, real]
            array = np.argsort(pair, kind="stable")
            pair, rows = pair[array], real[array]
            new = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
            first = np.flatnonzero(new)
            if len(first) == len(pair):
                continue
            whose = d[rows]
            again = rows[whose > np.minimum.reduceat(whose, first)[np.cumsum(new) - 1]]
            out.append((d[again], a[again] - n, a[again] - n + SPAN))
        lo = hi
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged_by_doc(*(np.concatenate(x) for x in zip(*out)))


def own_dictionary(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kinds, place, columns = ((np.int64, 8), (np.int64, 8), (np.int32, 4), (np.int32, 4), (np.uint8, PHRASE)), 0, []
                for kind, width in kinds:
                    columns.append(np.frombuffer(blob, kind, n * width // np.dtype(kind).itemsize, place))
                    place += n * width
                columns[4] = columns[4].reshape(n, PHRASE)
                parts.append(columns)
        if parts:
            yield from to_docs(n_buckets, 1, *suffixes(*(np.concatenate(x) for x in zip(*parts))))

    return run


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [without(d, body, spans + (more or b"")) for d, body, spans, more in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield to_batch(DONE, *zip(*rows))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Texts are UTF-8 bytes, a null text none. A byte is removed where a SPAN-byte
    string of its document covers it that also starts in a document with a
    smaller doc_id, judged on the input. Matches do not cross documents. A row
    with a null doc_id is neither smaller nor larger than any and stays whole.
    Repeated rows with one doc_id are one document; rows that share a doc_id
    with different texts each lose what any of them would, within their length.
    An empty table gives no rows. Pairs of phrases, and strings of hot triggers,
    count as equal by 96 hash bits or more of two bases (two different ones among
    10**13 would agree with a probability below 0.001), other strings by their bytes.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    tmp, n = Scratch(spark, "suffix"), partitions(spark)
    texts, found_schema = id_text(docs), "doc_bucket int, kind int, ids binary, starts binary, ends binary"
    parsed = texts.mapInArrow(parse(4 * n, 2 * n, hot_triggers(texts)), "bucket int, kind int, body binary").repartition(n, "bucket")
    found = tmp.save(parsed.mapInArrow(own_parse(2 * n), found_schema), "found")
    listed = tmp.save(found.repartition(n, "doc_bucket").mapInArrow(list_by_doc, "doc_id long, spans binary, open binary"), "listed")
    waiting = tmp.save(
        texts.join(listed, "doc_id", "left").select("doc_id", "text", "spans", "open").mapInArrow(
            settle, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, body binary, spans binary, open binary"
        ),
        "waiting",
    )
    tmp.drop("found", "listed")
    open_ = waiting.where("body is not null")
    phrases = open_.select("doc_id", "body", "open").mapInArrow(dictionary(4 * n), "bucket int, kind int, body binary").repartition(n, "bucket")
    more = tmp.save(phrases.mapInArrow(own_dictionary(2 * n), found_schema), "more")
    more = tmp.save(more.repartition(n, "doc_bucket").mapInArrow(list_by_doc, "doc_id long, spans binary, open binary"), "more_listed")
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    late = open_.select("doc_id", "body", "spans").join(more.select("doc_id", F.col("spans").alias("more")), "doc_id", "left")
    done = late.select("doc_id", "body", "spans", "more").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = tmp.save(waiting.where("body is null").select(result).union(done.select(result)), "result")
    tmp.keep("result")
    return out
