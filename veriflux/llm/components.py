"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Stars of so many links (16 bytes each) are joined in one task; more are joined by shuffles.
ONE_TASK = 1_000_000

LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node that these links join it to; roots are left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    child = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[child], nodes[parent[child]]


def local_stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Replaces a task's links by stars around the smallest node of each local component."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=LINK)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) > most:
            yield stars()
            held = []
    if held:
        yield stars()


def all_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return local_stars(batches, 1 << 62)


def components(links: DataFrame, tmp: Scratch, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component_id) for each node of links(u, v); component_id is the smallest reachable node.

    Nodes without links do not occur. Links may repeat; loops are dropped. Each
    task first contracts what it holds, so a star with a third of all nodes
    arrives as one thin row for each node. Where the stars are counted and found
    to be few, one task joins them; else alternating large and small stars do,
    with joins between written tables, which lets Spark split a hot node's rows.
    """
    links = links.where("u <> v").mapInArrow(local_stars, "u long, v long")
    edges = tmp.save(links.distinct(), f"{name}-0")
    if edges.count() <= one_task:
        done = tmp.save(edges.coalesce(1).mapInArrow(all_stars, "u long, v long"), f"{name}-done")
        tmp.drop(f"{name}-0")
        return done.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    for step in count(1):
        # small star: a node's smaller neighbours, and itself, move to the smallest of them
        least = tmp.save(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n")), f"{name}-least-{step}")
        loose = least.where("n > 1").select("u").limit(1).count()
        chained = edges.select(F.col("v").alias("u")).join(least.select("u"), "u", "left_semi").limit(1).count()
        if not loose and not chained:
            tmp.drop(f"{name}-least-{step}")
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        small = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        stars = tmp.save(small.repartition(partitions(edges.sparkSession)).mapInArrow(local_stars, "u long, v long").distinct(), f"{name}-small-{step}")
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        both = stars.union(stars.select("v", "u"))
        around = tmp.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-around-{step}")
        moved = stars.select(F.col("v").alias("u"), F.col("u").alias("x")).join(around, "u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        tmp.drop(f"{name}-{step - 1}", f"{name}-least-{step}")
        edges = tmp.save(moved.where("u <> v").union(stars.join(around, "u").select("u", F.col("m").alias("v")).where("u <> v")).distinct(), f"{name}-{step}")
        tmp.drop(f"{name}-small-{step}", f"{name}-around-{step}")
