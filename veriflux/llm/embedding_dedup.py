"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label fold into one class before anything is compared. A
label's classes are dealt into blocks; each pair of blocks is a tile, which gets
int8 codes, a scale and two norms of each of its vectors, no more. It multiplies
codes (exact in float32); |x.y - s_x s_y q_x.q_y| <= |e_x| |y| + |s_x q_x| |e_y|
bounds what quantisation can hide. A pair whose lower bound reaches the threshold
is linked; where only the upper bound does, the pair is open, and its two rows
are fetched once for the tile in full precision. A tile returns link counts, a
spanning forest of its links and such rows, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, small_text_batches, to_batch
from .components import components, forest

THRESHOLD = 0.93
#: Vectors that are multiplied at once, and blocks of them on one side of a tile at most: a class stands once in each row
#: and column of its label's tiles, so wide tiles shuffle less. A label has WIDE sides at least before tiles widen.
BLOCK, MOST_BLOCKS, WIDE = 1024, 32, 8
#: Names of classes whose vec_id names others too lie below minus this; vec_ids do not.
OWN_NAMES = 1 << 62

#: What a tile found: u has v more links (COUNT), u and v are in one component (TREE), u on side v has an open pair (ROW).
COUNT, TREE, ROW = 0, 1, 2
TILE = pa.schema([("group", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])
FOUND = "group long, x int, y int, kind int, u long, v long"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised rows and of their errors (rounded up), for unit rows."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    near = codes * scale[:, None]
    slack = 1 + 1e-9
    return codes.astype(np.int8), scale, np.linalg.norm(near, axis=1) * slack, np.linalg.norm(x - near, axis=1) * slack


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def bounded(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of two quantised sets are linked for sure, and which are open; for same, only i < j."""
    (qa, sa, ra, ea), (qb, sb, _, eb) = a, b
    qa, qb = qa.astype(np.float32), qb.astype(np.float32)
    # |codes| <= 127, so sums of up to 1000 products stay below 2**24 and float32 is exact
    dot = sum(qa[:, k : k + 1000].astype(np.float64) @ qb[:, k : k + 1000].T.astype(np.float64) for k in range(0, qa.shape[1], 1000)) if qa.shape[1] > 1000 else qa @ qb.T
    near, hidden = dot * np.outer(sa, sb), ea[:, None] * (1 + 1e-9) + np.outer(ra, eb) + 1e-9
    sure = near - hidden >= threshold
    open_ = (near + hidden >= threshold) & ~sure
    if same:
        sure, open_ = np.triu(sure, 1), np.triu(open_, 1)
    return sure, open_


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) have a cosine of at least threshold in double precision."""
    na, nb, out = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)), np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        out[k : k + 100_000] = (a[p] * b[q]).sum(1) / (na[p] * nb[q]) >= threshold
    return out


class Links:
    """Link counts and a spanning forest of a tile's links, added block by block."""

    def __init__(self, at: tuple, ids: list, sizes: list):
        self.at, self.ids, self.sizes = at, ids, sizes
        self.more, self.trees = [np.zeros(len(x), np.int64) for x in ids], []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            np.add.at(self.more[0], i, self.sizes[1][j])
            np.add.at(self.more[1], j, self.sizes[0][i])
            self.trees.append(forest(self.ids[0][i], self.ids[1][j]))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.trees:
            u, n = np.concatenate(self.ids), np.concatenate(self.more)
            child, parent = forest(*(np.concatenate(x) for x in zip(*self.trees)))
            for kind, a, b in ((COUNT, u[n > 0], n[n > 0]), (TREE, child, parent)):
                yield to_batch(TILE, *(np.full(len(a), k) for k in self.at), np.full(len(a), kind), a, b)


def blocks_of(at: tuple, sides: list, size: int) -> Iterator[tuple[slice, slice, bool]]:
    """Pairs of blocks of a tile's sides; of a tile on the diagonal those with i <= j, and whether i = j."""
    own = at[1] == at[2]
    for i in range(0, len(sides[0]), size):
        for j in range(i if own else 0, len(sides[1]), size):
            yield slice(i, i + size), slice(j, j + size), own and i == j


def by_tile(batches: Iterator[pa.RecordBatch], finish) -> Iterator[pa.RecordBatch]:
    """finish(tile, ids, sizes, bodies), each of the last three by side, for every tile that has both sides.

    Rows come sorted by tile and side, so one tile's vectors are held at a time.
    """

    def done():
        own = at[1] == at[2]
        if sides[0] and (own or sides[1]):
            rows = [list(zip(*s)) for s in (sides[0], sides[0] if own else sides[1])]
            yield from finish(at, *([np.array(r[0]) for r in rows], [np.array(r[1]) for r in rows], [r[2] for r in rows]))

    at, sides = None, ([], [])
    for batch in batches:
        for group, x, y, side, vec_id, n, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, x, y) != at:
                if at:
                    yield from done()
                at, sides = (group, x, y), ([], [])
            sides[side].append((vec_id, n, body))
    if at:
        yield from done()


def compare(threshold: float, block: int = BLOCK):
    """Sure links of tiles, and the rows that have open pairs; bodies are encode()'s."""

    def finish(at, ids, sizes, bodies):
        sides = []
        for body in bodies:
            table = np.frombuffer(b"".join(body), np.uint8).reshape(len(body), -1)
            norms = np.ascontiguousarray(table[:, :24]).view(np.float64)
            sides.append((table[:, 24:].view(np.int8), *norms.T))
        links, some = Links(at, ids, sizes), [np.zeros(len(x), bool) for x in ids]
        for p, q, same in blocks_of(at, ids, block):
            sure, open_ = bounded([x[p] for x in sides[0]], [x[q] for x in sides[1]], same, threshold)
            i, j = np.nonzero(sure)
            links.add(i + p.start, j + q.start)
            some[0][p] |= open_.any(1)
            some[1][q] |= open_.any(0)
        yield from links.rows()
        for side, rows in enumerate([some[0] | some[1]] if at[1] == at[2] else some):
            u = ids[side][rows]
            yield to_batch(TILE, *(np.full(len(u), k) for k in at), np.full(len(u), ROW), u, np.full(len(u), side))

    return lambda batches: by_tile(batches, finish)


def settle(threshold: float, block: int = BLOCK):
    """Links among the open pairs of tiles; bodies are whole vectors of the rows that compare() asked for."""

    def finish(at, ids, sizes, bodies):
        sides = [np.stack([*map(unpacked, b)]) for b in bodies]
        coded, links = [quantise(unit(x)) for x in sides], Links(at, ids, sizes)
        for p, q, same in blocks_of(at, ids, block):
            i, j = np.nonzero(bounded([x[p] for x in coded[0]], [x[q] for x in coded[1]], same, threshold)[1])
            linked = exact(sides[0][p], sides[1][q], i, j, threshold)
            links.add(i[linked] + p.start, j[linked] + q.start)
        yield from links.rows()

    return lambda batches: by_tile(batches, finish)


def packed(x: np.ndarray) -> bytes:
    """Doubles as bytes, of single precision where that holds them exactly; equal vectors give equal bytes."""
    short = x.astype(np.float32)
    return b"s" + short.tobytes() if (short == x).all() else b"d" + x.tobytes()


def unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.float32 if body[:1] == b"s" else np.float64, -1, 1).astype(np.float64)


def pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors as bytes, so that equal ones group by them.

    A power of two brings the largest component near 1, which changes no cosine
    and keeps squares of very large and very small numbers finite.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("body", pa.binary())])

    def body(v: list | None) -> bytes | None:
        x = None if v is None or None in v else np.array(v, np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            return None
        return packed(np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0)  # -0.0 becomes 0.0

    for batch in batches:
        found = [body(v) for v in batch.column(2).to_pylist()]
        yield to_batch(schema, batch.column(0), batch.column(1), [len(unpacked(b)) if b else 0 for b in found], found)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `coded` to each class: three doubles (scale, norms of the quantised row and of its error) and int8 codes."""
    for batch in batches:
        coded = []
        for body in batch.column("body").to_pylist():
            codes, *norms = quantise(unit(unpacked(body)[None, :]))
            coded.append(np.concatenate(norms).tobytes() + codes.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary())], names=[*batch.schema.names, "coded"])


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label).

    Vectors of one label, not null, and one length are linked when their cosine
    in double precision is at least threshold. A vector that is null, empty,
    zero, or holds null or non-finite components links with nothing, and neither
    does a row with a null vec_id; such rows are their own component. Repeated
    rows are different vectors with equal ids: each counts as a link, and rows of
    one id may have different labels and vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_text_batches(spark)
    tmp, n = Scratch(spark, "embeddings"), partitions(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = tmp.save(rows.mapInArrow(pack_vectors, "vec_id long, label string, dims int, body binary"), "packed")
    able = F.col("label").isNotNull() & F.col("body").isNotNull() & F.col("vec_id").isNotNull()
    key = ["label", "dims", "body"]
    folded = tmp.save(packed.where(able).groupBy(key).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")), "folded")
    repeated = tmp.save(folded.groupBy("first_id").agg(F.count("*").alias("of")).where("of > 1").select("first_id", F.lit(True).alias("again")), "repeated")
    several = repeated.limit(1).count() > 0
    # a class is named by its smallest vec_id, unless that is another class's too
    own = -F.pmod(F.xxhash64(*key), F.lit(OWN_NAMES)) - OWN_NAMES
    named = folded.join(repeated, "first_id", "left").withColumn("class_id", F.when(F.col("again"), own).otherwise(F.col("first_id"))) if several else folded.withColumn("class_id", F.col("first_id"))
    named = named.select(*key, "first_id", "n", "class_id")
    classes = tmp.save(named.mapInArrow(encode, "label string, dims int, body binary, first_id long, n long, class_id long, coded binary"), "classes")
    wide = F.least(F.greatest(F.floor(F.count("*") / (block * WIDE)), F.lit(1)), F.lit(MOST_BLOCKS)) * block
    blocks = tmp.save(classes.groupBy("label", "dims").agg(F.ceil(F.count("*") / wide).cast("int").alias("blocks")), "blocks")
    dealt = classes.select("label", "dims", "class_id", "n", "coded").join(blocks, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place, tile = ["group", "x", "y", "side"], ["group", "x", "y"]
    tiles = other.select(
        F.xxhash64("label", "dims").alias("group"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "class_id", "n", "coded",
    )
    found = tmp.save(tiles.repartition(n, *tile).sortWithinPartitions(place).mapInArrow(compare(threshold, block), FOUND), "found")
    wanted = found.where(F.col("kind") == ROW).select(*tile, F.col("v").cast("int").alias("side"), F.col("u").alias("class_id"))
    doubles = wanted.join(classes.select("class_id", "n", "body"), "class_id").select(*place, "class_id", "n", "body")
    found = found.union(tmp.save(doubles.repartition(n, *tile).sortWithinPartitions(place).mapInArrow(settle(threshold, block), FOUND), "settled"))
    comp = components(found.where(F.col("kind") == TREE).select("u", "v"), tmp).select(F.col("id").alias("class_id"), "component_id")
    counts = found.where(F.col("kind") == COUNT).groupBy(F.col("u").alias("class_id")).agg(F.sum("v").alias("more"))
    verdicts = classes.select(*key, "class_id", "first_id", "n").join(comp, "class_id", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    if several:  # names of classes stand for no vector: a component is named by its smallest one
        verdicts = tmp.save(verdicts, "joined")
        least = verdicts.groupBy("component_id").agg(F.min("first_id").alias("least"))
        verdicts = verdicts.join(least, "component_id").withColumn("component_id", F.col("least"))
    verdicts = verdicts.join(counts, "class_id", "left")
    verdicts = tmp.save(verdicts.select(*key, (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "verdicts")
    linked = packed.where(able).join(verdicts, key).select("vec_id", "n_links", "component_id")
    alone = packed.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = tmp.save(linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")
    tmp.keep("result")
    return result
