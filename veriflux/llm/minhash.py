"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join.

A signature is CHUNKS * WIDTH symbols of b bits, one for each of as many
permutations. By pigeonhole, two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols agree, up to ERRORS symbols, in one chunk;
each chunk is indexed once for each way of leaving ERRORS of its symbols out, so
every such pair meets in a bucket. At a similarity of 0.75 a pair that never
meets has probability (1 - .75**5 - 5*.25*.75**4)**10 = 4e-5.

Documents with one shingle set are one node. A small bucket gives all its pairs,
a large one stars: a task that indexes many of its members links them to one of
them and sends only that one on, so an owner never holds a whole bucket. Links
are confirmed on full shingle sets, in rounds that skip pairs already known to
be connected. Members of a large bucket that are then still outside its main
component are strays. All buckets with one main component form one group, in
which each node stands once, and strays are compared with the group in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_AZ, Scratch, id_text, likely, mix64, partitions, small_text_batches, spread, survivors, to_batch
from .components import components

CHUNKS, WIDTH, ERRORS, BITS = 10, 5, 1, 16
SYMBOLS = CHUNKS * WIDTH
SHINGLE_WORDS = 5
#: Similarity in percent from which documents are linked.
#: Names of sets whose doc_id has other sets lie below minus this; doc_ids do not.
OWN_NAMES = 1 << 62
PERCENT = 75
#: Buckets up to this size give all their pairs; larger ones stars, then tiles.
SMALL_BUCKET = 6
#: Nodes that a task indexes at once, and folds the large buckets of.
INDEX_ROWS = 16_384
BLOCK = 2048
BLOCK_SHINGLES = 2_000_000
#: Pairs whose signatures differ in more symbols are not confirmed: at similarity
#: 0.75 the count is binomial(50, 1/4), above 27 with probability 2.9e-6.
FAR = 27

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("signature", pa.binary())])
BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("size", pa.int64())])

_rng = np.random.RandomState(20240501)
SCALE = (_rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFT = _rng.randint(0, 1 << 31, SYMBOLS).astype(np.uint32)
ROLL = np.uint64(0x9E3779B97F4A7C15)
POSITION = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * ROLL)
WITHOUT = mix64(np.arange(1000, 1000 + SYMBOLS, dtype=np.uint64) * ROLL)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's 5-word shingles (fewer words: one shingle; none: empty)."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(len(h), SHINGLE_WORDS)
    rolled = h[: len(h) - n + 1]
    for i in range(1, n):
        rolled = rolled * ROLL + h[i : len(h) - n + 1 + i]
    return np.unique(mix64(rolled + np.uint64(n)))


def signature(found: np.ndarray) -> np.ndarray:
    """SYMBOLS values of BITS bits: for each permutation, bits of the shingle that comes first."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (SCALE[:, None] * x[None, i : i + 4096] + SHIFT[:, None]).min(1))
    return (mix64(least.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.uint16)


def mark(text: str | None, found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, or for a text without words, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(found.tobytes() if len(found) else (text or "").encode("utf-8", "surrogatepass"))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = shingles(text, words)
            rows.append((len(found), *mark(text, found), signature(found).tobytes()))
        if rows:
            yield to_batch(SIGNED, batch.column(0), *zip(*rows))


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        yield to_batch(schema, batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))


def marked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shingle_sets() by the hash of the set."""
    for batch, sets in ((b, next(shingle_sets(iter([b])))) for b in batches):
        marks = [mark(t, np.array(s, np.int64)) for t, s in zip(batch.column(1).to_pylist(), sets.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1)), sets.column(1)], names=["set_hi", "set_lo", "shingles"])


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, SYMBOLS) keys: each chunk with each one of its symbols left out."""
    each = mix64(signatures.astype(np.uint64) + POSITION)
    whole = each.reshape(len(each), CHUNKS, WIDTH).sum(2, dtype=np.uint64)
    return mix64(np.repeat(whole, WIDTH, 1) - each + WITHOUT)


def index(n_buckets: int):
    """Bucket entries for the owners of their keys (kind 0), and stars of a task's own large buckets (kind 1)."""

    def flush(ids: list[np.ndarray], signatures: list[bytes]) -> Iterator[pa.RecordBatch]:
        node = np.concatenate(ids)
        key = chunk_keys(np.frombuffer(b"".join(signatures), np.uint16).reshape(len(node), SYMBOLS)).ravel()
        node = np.repeat(node, SYMBOLS)
        key, node, start, size = buckets(key, node)
        many, begin = np.repeat(size, size), np.repeat(start, size)
        star = (many > SMALL_BUCKET) & (begin != np.arange(len(key)))
        if star.any():
            i = np.flatnonzero(star)
            # these pass their owner by, so they may go to any
            for at, blobs in spread((mix64(node[i].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), [node[begin[i]], node[i], key[i].view(np.int64), many[i]]):
                yield to_batch(BLOB, [at], [1], [np.int64(len(blobs[0]) // 8).tobytes() + b"".join(blobs)])
        i = np.flatnonzero(~star)
        weight = np.where(many[i] > SMALL_BUCKET, many[i], 1)
        for at, blobs in spread((key[i] % np.uint64(n_buckets)).astype(np.int32), [key[i], node[i], weight]):
            yield to_batch(BLOB, [at], [0], [np.int64(len(blobs[0]) // 8).tobytes() + b"".join(blobs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, signatures = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                signatures += batch.column(1).to_pylist()
            if len(signatures) >= INDEX_ROWS:
                yield from flush(ids, signatures)
                ids, signatures = [], []
        if signatures:
            yield from flush(ids, signatures)

    return run


def buckets(key: np.ndarray, node: np.ndarray, *more: np.ndarray):
    """The rows sorted by key, in a pseudo-random order of its own within each; each bucket's start and size."""
    order = np.lexsort((mix64(node.view(np.uint64) ^ key), key))
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key, node[order], *(x[order] for x in more), start, np.diff(np.r_[start, len(key)])


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars and, of small buckets, all pairs; size is the bucket's, so that large ones can be told."""
    held = []
    for batch in batches:
        for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n = int.from_bytes(body[:8], "little")
            if kind:
                yield to_batch(PAIR, *np.frombuffer(body, np.int64, 4 * n, 8).reshape(4, n))
            else:
                held.append(np.frombuffer(body, np.int64, 3 * n, 8).reshape(3, n))
    if not held:
        return
    key, node, weight = np.concatenate(held, 1)
    key, node, weight, start, size = buckets(key.view(np.uint64), node, weight)
    n, begin = np.repeat(np.add.reduceat(weight, start), size), np.repeat(start, size)
    place = np.arange(len(key)) - begin
    out = []
    for gap in range(1, SMALL_BUCKET):
        i = np.flatnonzero((n <= SMALL_BUCKET) & (place >= gap))
        out.append((node[i - gap], node[i], np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)))
    i = np.flatnonzero((n > SMALL_BUCKET) & (place > 0))
    out.append((node[begin[i]], node[i], key[i].view(np.int64), n[i]))
    a, b, bucket, many = (np.concatenate(x) for x in zip(*out))
    if not len(a):
        return
    a, b = np.where(bucket == 0, np.minimum(a, b), a), np.where(bucket == 0, np.maximum(a, b), b)
    # pairs that several small buckets of this task share leave it once
    order = np.lexsort((b, a, bucket))
    a, b, bucket, many = a[order], b[order], bucket[order], many[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (bucket[1:] != bucket[:-1])]
    for i in range(0, len(new := np.flatnonzero(new)), 50_000):
        at = new[i : i + 50_000]
        yield to_batch(PAIR, a[at], b[at], bucket[at], many[at])


def differing(left, right):
    """Symbols in which two signatures differ, for columns of signatures."""
    return (left.reshape(-1, SYMBOLS) != right.reshape(-1, SYMBOLS)).sum(1)


def near_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose signatures are too far apart. Columns: a, b, then both signatures."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16) for i in (2, 3))
            yield batch.filter(pa.array(differing(left, right) <= FAR)).select(["a", "b"])


def tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a part of a group's strays with a block of its nodes, on full sets.

    Rows come sorted by group, block, part and role, strays (role 0) first. Two
    strays are compared once, where the smaller one stands among the strays.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    at, strays, nodes, held = None, [], [], 0

    def compare():
        if not strays or not nodes:
            return
        mid, mcomp, mstray, msig, mset = zip(*nodes)
        msig = np.frombuffer(b"".join(msig), np.uint16).reshape(-1, SYMBOLS)
        mid, mcomp, mstray = np.array(mid), np.array(mcomp), np.array(mstray)
        sizes = np.array([len(x) for x in mset])
        for sid, scomp, _, ssig, sset in strays:
            open_ = (mcomp != scomp) & (~mstray | (mid > sid))
            open_ &= (100 * np.minimum(sizes, len(sset)) >= PERCENT * np.maximum(sizes, len(sset)))  # sets too unequal in size cannot be similar
            i = np.flatnonzero(open_)
            near = i[differing(np.frombuffer(ssig, np.uint16), msig[i]) <= FAR]
            if not len(near):
                continue
            values = np.concatenate([mset[j] for j in near])
            hit = sset[np.minimum(np.searchsorted(sset, values), len(sset) - 1)] == values
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            linked = near[100 * both >= PERCENT * (sizes[near] + len(sset) - both)]
            if len(linked):  # one link to each component is enough
                linked = linked[np.unique(mcomp[linked], return_index=True)[1]]
                yield to_batch(schema, np.minimum(mid[linked], sid), np.maximum(mid[linked], sid))

    for batch in batches:
        sets = batch.column(8)
        values, ends = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        for row, (group, block, part, role, node, comp, stray, sig) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(8)))):
            if (group, block, part) != at:
                yield from compare()
                at, strays, nodes, held = (group, block, part), [], [], 0
            found = np.sort(values[ends[row] : ends[row + 1]])
            (nodes if role else strays).append((node, comp, stray, sig, found))
            held += len(found) * role
            if held > BLOCK_SHINGLES:
                yield from compare()
                nodes, held = [], 0
    yield from compare()


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v): pairs whose full shingle sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("left") + F.size("right")).alias("sum"))
        .where(100 * F.col("both") >= PERCENT * (F.col("sum") - F.col("both")))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of nodes that are not known to be connected."""
    a = comp.select(F.col("id").alias("a"), F.col("component_id").alias("ca"))
    b = comp.select(F.col("id").alias("b"), F.col("component_id").alias("cb"))
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def tiles(large: DataFrame, comp: DataFrame, nodes: DataFrame, sets: DataFrame, tmp: Scratch) -> DataFrame:
    """What stars cannot decide: strays of large buckets beside the nodes that they share one with.

    Buckets with one main component are one group, where comparing all its
    strays with all its nodes is no more work than going bucket by bucket, as it
    is for copies that meet in many buckets; else each of them is its own group.
    A group has ceil(nodes / BLOCK) blocks and as many parts of strays.
    """
    member = large.select("bucket", F.col("b").alias("id")).union(large.select("bucket", F.col("a").alias("id"))).distinct()
    placed = tmp.save(member.join(comp, "id", "left").select("bucket", "id", F.coalesce("component_id", "id").alias("comp")), "placed")
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket")
    main = sizes.agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), (F.sum("n") * (F.sum("n") - F.max("n"))).cast("double").alias("work"), F.count("*").alias("comps"))
    main = tmp.save(main.where("comps > 1").drop("comps"), "main")
    open_ = placed.join(main, "bucket")
    stray = F.col("comp") != F.col("main")
    united = open_.groupBy("main", "id").agg(F.max(stray.cast("int")).alias("stray"))
    united = united.groupBy("main").agg((F.count("*") * F.sum("stray")).cast("double").alias("united"))
    split = united.join(main.groupBy("main").agg(F.sum("work").alias("work")), "main").where("united > work").select("main", F.lit(True).alias("split"))
    chosen = tmp.save(main.join(split, "main", "left").select("bucket", "main", F.when(F.col("split"), F.col("bucket")).alias("own")), "chosen")
    keyed = placed.join(chosen, "bucket").select("main", F.col("own").alias("bucket"), "id", "comp")
    keyed = tmp.save(keyed.groupBy("main", "bucket", "id", "comp").agg(F.lit(1).alias("one")).drop("one"), "keyed")
    parts = lambda n: (F.floor((n - 1) / BLOCK) + 1).cast("int")
    counts = keyed.groupBy("main", "bucket").agg(parts(F.count("*")).alias("blocks"), parts(F.sum(stray.cast("int"))).alias("parts"))
    counts = tmp.save(counts.select(F.col("main").alias("main_"), F.col("bucket").alias("bucket_"), "blocks", "parts"), "counts")
    group = keyed.join(counts, (F.col("main") == F.col("main_")) & F.col("bucket").eqNullSafe(F.col("bucket_")))
    group = group.select(F.xxhash64("main", "bucket").alias("group"), "blocks", "parts", "id", "comp", stray.alias("stray"))
    full = group.join(nodes.select("id", "signature"), "id").join(sets.dropDuplicates(["id"]), "id")
    of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["group", "block", "part", "role", "id", "comp", "stray", "signature", "shingles"]
    strays = full.where("stray").withColumn("part", of("parts", 1)).withColumn("role", F.lit(0)).withColumn("block", each("blocks"))
    rest = full.withColumn("block", of("blocks", 2)).withColumn("role", F.lit(1)).withColumn("part", each("parts"))
    n = partitions(large.sparkSession)
    return strays.select(row).union(rest.select(row)).repartition(n, "group", "block", "part").sortWithinPartitions("group", "block", "part", "role")


def minhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    A document's set holds the distinct 5-word shingles of its text with A-Z in
    lower case; fewer words make one shingle; a null or empty text has an empty
    set, which links with nothing. Documents are linked when the intersection is
    at least 75 percent of the union, on full sets. kept: doc_id = component_id.
    Rows with a null doc_id link with nothing, have a null component_id and are
    kept. Repeated rows are one document; rows of one doc_id with different sets
    are different documents that share an id, each linked by its own set. An empty
    table gives no rows.
    """
    return verdicts(docs).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, one of each group of linked documents.

    The document with the smallest doc_id stays. Of rows with one doc_id, or with
    none, and equal shingle sets the first in hash order stays; rows without a
    doc_id link with nothing else, and rows without words with nothing at all:
    of these, equal texts (A-Z in lower case) with one doc_id are one.
    """
    found = verdicts(docs)

    def keyed(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = WordHashes()
            for batch in batches:
                marks = [mark(t, shingles(t, words)) for t in batch.column(2).to_pylist()]
                if marks:
                    columns = [*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*marks))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "set_hi", "set_lo"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("set_hi", T.LongType()), T.StructField("set_lo", T.LongType())]))

    return survivors(docs, found, ["set_hi", "set_lo"], keyed)


def verdicts(docs: DataFrame) -> DataFrame:
    """minhash_dedup() with set_hi and set_lo, the hash of the document's set (of its text, where that has no words)."""
    spark = docs.sparkSession
    small_text_batches(spark)
    tmp, n = Scratch(spark, "minhash"), partitions(spark)
    texts = id_text(docs)
    signed = tmp.save(texts.mapInArrow(sign, "doc_id long, n_shingles long, set_hi long, set_lo long, signature binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    mark_ = F.struct("set_hi", "set_lo")
    repeated = full.groupBy("doc_id").agg(F.min(mark_).alias("a"), F.max(mark_).alias("b")).where("a <> b")
    repeated = tmp.save(repeated.select("doc_id"), "repeated")  # ids of rows with different sets
    several = repeated.limit(1).count() > 0
    nodes = tmp.save(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature")).withColumn("id", F.col("first")), "nodes")
    if several:  # a set is named by its smallest doc_id, unless that has other sets too
        again = repeated.select(F.col("doc_id").alias("first"), F.lit(True).alias("again"))
        own = -F.pmod(F.xxhash64("set_hi", "set_lo"), F.lit(OWN_NAMES)) - OWN_NAMES
        nodes = tmp.save(nodes.join(again, "first", "left").withColumn("id", F.when(F.col("again"), own).otherwise(F.col("first"))).drop("again"), "named")

    found = nodes.select("id", "signature").mapInArrow(index(4 * n), "bucket int, kind int, body binary").repartition(n, "bucket")
    pairs = tmp.save(found.mapInArrow(candidates, "a long, b long, bucket long, size long"), "pairs")
    left = nodes.select(F.col("id").alias("a"), F.col("signature").alias("left"))
    right = nodes.select(F.col("id").alias("b"), F.col("signature").alias("right"))
    near = tmp.save(
        pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(near_only, "a long, b long"),
        "near",
    )
    # full sets of the nodes that may have a link; the members of a large bucket are among them
    large = pairs.where("bucket <> 0")
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select("b")).union(large.select("a")).union(large.select("b")).distinct()
    wanted = tmp.save(wanted, "wanted")
    near_texts = likely(texts, wanted).where("likely").select("doc_id", "text")
    sets = tmp.save(near_texts.join(wanted, "doc_id", "left_semi").mapInArrow(shingle_sets, "id long, shingles array<long>"), "sets")
    links, comp = None, None
    if several:
        found = texts.join(repeated, "doc_id", "left_semi").mapInArrow(marked_sets, "set_hi long, set_lo long, shingles array<long>").where(F.size("shingles") > 0)
        named = nodes.where(F.col("id") <= -OWN_NAMES).select("set_hi", "set_lo", "id")
        sets = sets.union(tmp.save(found.join(named, ["set_hi", "set_lo"]).dropDuplicates(["id"]).select("id", "shingles"), "more_sets"))

    # each node's first pair, then its first three that still lead elsewhere, then all that do
    for step, most in enumerate((1, 3, None)):
        todo = near if comp is None else across(near, comp)
        if most == 1:
            todo = todo.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("a"))
        elif most:
            slots = todo.groupBy("b", F.pmod(F.xxhash64("a"), F.lit(most)).alias("slot"))
            todo = slots.agg(F.min_by("a", F.xxhash64("a")).alias("a"))
        new = tmp.save(confirm(todo.select("a", "b"), sets), f"links-{step}")
        links = new if links is None else links.union(new)
        comp = components(links, tmp, f"comp-{step}")

    new = tmp.save(tiles(large, comp, nodes, sets, tmp).mapInArrow(tile_links, "u long, v long"), "links-last")
    comp = components(links.union(new), tmp, "comp-last")

    ids = nodes.select("set_hi", "set_lo", "id", "first").join(comp, "id", "left").select("set_hi", "set_lo", "first", F.coalesce("component_id", "id").alias("component_id"))
    ids = tmp.save(ids, "ids")
    if several:  # names of sets stand for no document: a component is named by its smallest one
        least = ids.groupBy("component_id").agg(F.min("first").alias("least"))
        ids = tmp.save(ids.join(least, "component_id").select("set_hi", "set_lo", F.col("least").alias("component_id")), "least")
    ids = ids.select("set_hi", "set_lo", "component_id")
    joined = full.join(ids, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", "component_id", "set_hi", "set_lo")
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_hi", "set_lo")
    result = tmp.save(joined.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    tmp.keep("result")
    return result
