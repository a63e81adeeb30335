"""Clusters of integer vectors around centroids, by partial-distance search.

Vectors become integers once and are written to the shared folder. A round reads
them, finds each vector's nearest centroid and adds up the members of each; only
sums by centroid and dimension reach the driver, never vectors but the seeds.

The search adds squared differences over a few dimensions at a time, those of
high variance first. The centroid that leads after the first few is finished at
once, and its distance bounds the rest: a centroid whose partial sum is strictly
above the bound is abandoned, survivors finish all dimensions. All arithmetic is
in integers, so ties are exact and no order of tasks changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, to_batch

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Dimensions that the search adds at a time.
STEP = 8
#: Components reach from -LIMIT to LIMIT, so that 64 squared differences fit in a long.
LIMIT = 1 << 27

CODED = pa.schema([("vec_id", pa.int64()), ("body", pa.binary())])
SPREAD = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sum", pa.float64()), ("squares", pa.float64())])
SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("sum", pa.int64())])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def code(dims: int, scale: int):
    """The usable vectors' components as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            ids, vectors = batch.column(0).filter(fit), batch.column(1).filter(fit)
            x = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # a null component becomes nan
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                good = (np.abs(x) <= LIMIT).all(1)
            codes = x[good].astype("<i4")
            yield to_batch(CODED, ids.filter(pa.array(good)), [c.tobytes() for c in codes])

    return run


def decoded(bodies: pa.Array) -> np.ndarray:
    rows = bodies.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1).astype(np.int64)


def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of vectors, sums and sums of squares by dimension."""
    n, sums, squares = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            x = decoded(batch.column(0)).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x * x).sum(0)
    if n:
        yield to_batch(SPREAD, np.arange(len(sums)), np.full(len(sums), n), sums, squares)


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance."""
    partial = ((x[:, None, :step] - centroids[None, :, :step]) ** 2).sum(2)
    rows = np.arange(len(x))
    lead = partial.argmin(1)
    best = partial[rows, lead] + ((x[:, step:] - centroids[lead, step:]) ** 2).sum(1)
    open_ = partial <= best[:, None]  # strictly above the bound: abandoned
    open_[rows, lead] = False
    row, other = np.nonzero(open_)
    so_far = partial[row, other]
    for lo in range(step, x.shape[1], step):
        so_far += ((x[row, lo : lo + step] - centroids[other, lo : lo + step]) ** 2).sum(1)
        still = so_far <= best[row]
        row, other, so_far = row[still], other[still], so_far[still]
    least = best.copy()
    np.minimum.at(least, row, so_far)
    cluster = np.where(best == least, lead, len(centroids))
    ties = so_far == least[row]
    np.minimum.at(cluster, row[ties], other[ties])
    return cluster, least


def searched(centroids: np.ndarray, order: np.ndarray):
    """nearest() for batches of bodies, with dimensions in this order."""
    sorted_ = np.ascontiguousarray(centroids[:, order])
    return lambda bodies: nearest(np.ascontiguousarray(decoded(bodies)[:, order]), sorted_)


def add_up(centroids: np.ndarray, order: np.ndarray):
    """A task's number of members and sums of components by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = searched(centroids, order), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster, _ = search(batch.column(0))
                n += np.bincount(cluster, minlength=len(n))
                np.add.at(sums, cluster, decoded(batch.column(0)))
        k, dims = sums.shape
        some = np.repeat(n > 0, dims)
        yield to_batch(SUMS, *(c[some] for c in (np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), np.repeat(n, dims), sums.ravel())))

    return run


def assign(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searched(centroids, order)
        for batch in batches:
            if batch.num_rows:
                yield to_batch(ASSIGNED, batch.column(0), *search(batch.column(1)))

    return run


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for every usable row of vectors(vec_id, embedding), and the final centroids.

    Usable vectors have exactly dims components, none null, non-finite or beyond
    LIMIT / scale; others give no row. A component x counts as floor(scale * x).
    Seeds are the vectors with the smallest sha256 of `seed:vec_id` (a null id:
    `seed:null`; equal ids: by components), fewer where there are fewer vectors.
    Each round assigns every vector to the nearest centroid (squared distance,
    ties to the smaller number) and moves each centroid that has members to the
    floors of their means. Repeated rows count each; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tmp = Scratch(spark, "centroids")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    coded = tmp.save(rows.mapInArrow(code(dims, scale), "vec_id long, body binary"), "coded")
    hashed = coded.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256))
    seeds = [bytes(r.body) for r in hashed.orderBy("hash", "body").limit(centroids).collect()]
    at = np.frombuffer(b"".join(seeds), "<i4").reshape(-1, dims).astype(np.int64)
    if not len(at):
        return coded.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    spread = coded.select("body").mapInArrow(moments, "dim int, n long, sum double, squares double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("squares").alias("squares"))
    variance = {r.dim: r.squares / r.n - (r.sum / r.n) ** 2 for r in spread.collect()}
    order = np.array(sorted(variance, key=lambda d: (-variance[d], d)))
    for _ in range(rounds):
        sums = coded.select("body").mapInArrow(add_up(at, order), "cluster int, dim int, n long, sum long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        at = at.copy()
        for r in sums.collect():  # a row for each centroid and dimension
            at[r.cluster, r.dim] = r["sum"] // r.n
    assigned = tmp.save(coded.mapInArrow(assign(at, order), "vec_id long, cluster int, distance long"), "assigned")
    tmp.drop("coded")
    return assigned, at.tolist()


def summarised(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia and inertia (null beyond a long) and centroid_sha256 to the rows of cluster()."""
    by_cluster = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    rows = [(c, long(n), long(sum(by_cluster.values())), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, n in by_cluster.items()]
    totals = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid
