"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document has a pseudo-random 64-bit place within its source; the leading
BLOCK_BITS of it name its block. A source's target is a number of whole epochs
and a rest. The rest ends at one place, found by radix descent: each level
adds up at most FANOUT sums for each source, so no task sees a whole source.
The drawn blocks of all sources are dealt to output shards by a binary tree: at
each node the left half's share of every source's quota is one draw from the
multivariate hypergeometric distribution, so quotas add up exactly and blocks
are disjoint. Within a shard, documents are in pseudo-random order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.corpus import numbered
from .common import Scratch, id_text, partitions

WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Where a word ends and others may follow.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
BLOCK_BITS, LEVEL_BITS = 10, 8
BLOCKS, FANOUT = 1 << BLOCK_BITS, 1 << LEVEL_BITS
#: Rows of a source that are put in order at once when its target's end is found.
AT_ONCE = 100_000
SHARDS = 16
#: So many sources, consecutive in their order, share one splitting tree.
TREE_SOURCES = 50_000


def targets(sizes: list[float], weights: list[float], share: float = SHARE, ceiling: float = CEILING) -> list[float]:
    """Shares of share * sum(sizes) by weight; what is above ceiling * size is reshared until nothing is."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            out[i] = rest * weights[i] / total
        over = [i for i in open_ if out[i] > ceiling * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = ceiling * sizes[i]
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) block quotas whose sums over shards are quotas."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take, rng = int(quotas.sum()) * left // shards, np.random.default_rng(seed)
    # quotas add up to at most 3 * BLOCKS * TREE_SOURCES, below the method's limit of 10**9
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if len(quotas) else quotas
    return np.vstack([splitting_tree(drawn, left, 2 * seed), splitting_tree(quotas - drawn, shards - left, 2 * seed + 1)])


def place(seed: int) -> Column:
    """Rows of sized() tie only where doc_id and text are equal."""
    return F.xxhash64(F.col("doc_id"), F.col("text_hash"), F.lit(seed))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    rows = id_text(docs, F.col("source").cast("string").alias("source"), *more)
    return rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("text_hash", F.xxhash64("text")).drop("text")


def weighed(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """(source, number, size, weight) of every source, in code-point order with null last."""
    sizes = tmp.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    named = numbered(sizes.where("source is not null"), "source", "number", 0)
    rest = sizes.where("source is null").withColumn("number", F.lit(sizes.where("source is not null").count()).cast("long"))
    every = named.union(rest.select(named.columns))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("number", F.lit(len(WEIGHTS))).cast("int") + 1)
    return tmp.save(every.withColumn("weight", weight.cast("double")), "weighed")


def targeted(sources: DataFrame) -> DataFrame:
    """Adds targets() to the sources: a round is one sum over them, and the share of a unit of weight can but grow."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    room, closed, unit = F.col("source_size") * CEILING, -1, 0.0
    while weight:
        rest = SHARE * total - (full if closed >= 0 else 0.0)
        unit = rest / weight
        over = room < F.lit(unit) * F.col("weight")
        now, full, weight = sources.agg(F.count_if(over), F.sum(F.when(over, room).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if now == closed or (closed < 0 and not now):
            break
        closed = now
    return sources.withColumn("target", F.least(room, F.lit(unit) * F.col("weight")))


def edges(sums: DataFrame, order: str) -> DataFrame:
    """The row of each source at which its sums, in this order, reach what is left of its target; left counts from that row on."""
    until = Window.partitionBy("of").orderBy(order)  # FANOUT rows of a source, or AT_ONCE
    ends = sums.withColumn("sum", F.sum("words").over(until)).where(F.col("sum") >= F.col("left"))
    return ends.withColumn("left", F.col("left") - F.col("sum") + F.col("words")).groupBy("of").agg(F.min_by(F.struct(*sums.columns), order).alias("e")).select("e.*")


def plan_sources(rows: DataFrame, seed: int, shards: int, tmp: Scratch) -> DataFrame:
    """For each source: its target, how often it is taken whole, where its last, partial epoch ends, and the shards' shares of its blocks.

    All of it is made by joins and sums by source, so sources may be many; Spark
    broadcasts the written tables of few.
    """
    plans = targeted(weighed(rows, tmp))
    size, target = F.col("source_size"), F.col("target")
    plans = plans.withColumn("epochs", F.when(size > 0, F.least(F.floor(target / size), F.lit(int(CEILING)))).otherwise(0).cast("int"))
    plans = tmp.save(plans.withColumn("left", F.rint(target - F.col("epochs") * size).cast("long")), "plans")
    # radix descent: a digit of the edge a level, for all sources at once, until few rows of each source are near it
    of_source = F.col("source").eqNullSafe(F.col("of"))
    edge = plans.where((F.col("left") >= 1) & (F.col("epochs") < CEILING)).select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), "left")
    near = rows.select("source", "size", place(seed).alias("place"))
    for bits in range(0, 64, LEVEL_BITS):
        digit = F.shiftrightunsigned("place", 64 - bits - LEVEL_BITS).bitwiseAND(F.lit(FANOUT - 1).cast("long"))
        sums = near.join(edge, of_source).groupBy("of", "prefix", "left", digit.alias("d")).agg(F.sum("size").alias("words"))
        ends = edges(sums, "d").select("of", (F.shiftleft("prefix", LEVEL_BITS) if bits else F.lit(0).cast("long")).bitwiseOR(F.col("d")).alias("prefix"), "left")
        edge = tmp.save(ends, f"edge-{bits}")
        here = F.shiftrightunsigned("place", 64 - bits - LEVEL_BITS) == F.col("prefix")
        near = tmp.save(near.join(edge, of_source & here).select("source", "size", "place"), f"near-{bits}")
        if (near.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= AT_ONCE:
            break
    sums = near.join(edge, of_source).groupBy("of", "left", unsigned(F.col("place")).alias("place")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    edge = tmp.save(edges(sums, "place").select("of", unsigned(F.col("place")).alias("prefix"), "left", "n"), "edge")
    joined = plans.drop("left").join(edge, F.col("source").eqNullSafe(F.col("of")), "left")
    last = F.coalesce(F.shiftrightunsigned("prefix", 64 - BLOCK_BITS) + 1, F.lit(0)).cast("int")
    joined = joined.select(
        "number", F.col("source").alias("source_"), "source_size", "target", "epochs", unsigned(F.coalesce("prefix", F.lit(0).cast("long"))).alias("edge"),
        F.coalesce(F.floor(F.col("left") / F.col("n")), F.lit(0)).cast("long").alias("at_edge"), last.alias("last_blocks"),
    )
    schema = T.StructType([*joined.schema.fields, T.StructField("dealt", T.ArrayType(T.LongType()))])

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number", ignore_index=True)
        quotas = (part["epochs"].astype(np.int64) * BLOCKS + part["last_blocks"]).to_numpy(np.int64)
        tree = splitting_tree(quotas, shards, seed + int(part["number"].iloc[0]))
        return part.assign(dealt=list(tree.cumsum(0).T))

    trees = joined.groupBy(F.floor(F.col("number") / TREE_SOURCES)).applyInPandas(deal, schema)  # TREE_SOURCES rows each
    return tmp.save(trees, "dealt")


def unsigned(place_: Column) -> Column:
    """Signed order of the result is unsigned order of the argument."""
    return place_.bitwiseXOR(F.lit(-(1 << 63)))


def mix(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, epochs, rest, taken, shards.

    size counts maximal runs of other than space and \\t-\\r; a null text has 0.
    Sources, in code-point order with null last, weigh 3, 1, 2 and so on over.
    A document is taken epochs times whole, and rest words of it once more: all
    of it, none, or a part of it for the one at which the source's target ends
    (rows that tie there have one doc_id and text, and get equal parts of it). taken is the sum; it is
    at most 2 * size. shards holds the output shard of each of these draws, in
    epoch order. Equal inputs give equal results in any partitioning. A source
    without words has target 0. Rows with a null doc_id are told apart by their texts. An empty table gives no rows.
    """
    tmp = Scratch(docs.sparkSession, "mixing")
    rows = tmp.save(sized(docs), "sized")
    return drawn(rows, plan_sources(rows, seed, shards, tmp), seed)


def drawn(rows: DataFrame, plans: DataFrame, seed: int, *more: str) -> DataFrame:
    """mix() for the sized rows of these plans, with more of their columns."""
    joined = rows.join(plans, F.col("source").eqNullSafe(F.col("source_")))
    here, block = unsigned(place(seed)), F.shiftrightunsigned(place(seed), 64 - BLOCK_BITS).cast("long")
    rest = F.when(here < F.col("edge"), F.col("size")).when((here == F.col("edge")) & (F.col("last_blocks") > 0), F.least("size", "at_edge")).otherwise(0).cast("long")
    shard_of = lambda draw: F.size(F.filter("dealt", lambda x: x <= draw)).cast("int")
    whole = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("epochs")), lambda e: e < F.col("epochs")),
        lambda e: shard_of(e * BLOCKS + F.pmod(block * (2 * e + 5) + 389 * e, F.lit(BLOCKS))),  # an odd factor permutes the blocks
    )
    last = F.when(F.col("rest") > 0, F.array(shard_of(F.col("epochs") * BLOCKS + F.pmod(block + F.xxhash64("source", F.lit(seed)), F.col("last_blocks"))))).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("rest", rest).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "rest",
        (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"), F.concat(whole, last).alias("shards"), *more,
    )


def laid_out(draws: DataFrame, seed: int, shards: int, *more: str) -> DataFrame:
    """A row for each draw, with its words: sorted at random within a shard."""
    rows = draws.select("doc_id", F.posexplode("shards").alias("copy", "shard"), "size", "epochs", "rest", *more)
    words = F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("rest"))
    rows = rows.select("doc_id", "shard", "copy", words.alias("words"), F.xxhash64("doc_id", "copy", F.lit(seed)).alias("order"), "size", *more)
    # the order is a hash, so even ranges of it within each shard are even partitions, without a pass that samples them
    each = max(1, partitions(draws.sparkSession) // shards)
    place_ = F.shiftrightunsigned(unsigned(F.col("order")), 33)  # 31 leading bits, in the order that sorting has
    rank = F.floor(place_ * each / F.lit(1 << 31))
    rows = rows.withColumn("part", (F.col("shard") * each + rank).cast("int"))
    return rows.repartitionById(shards * each, "part").sortWithinPartitions("shard", "order").drop("order", "part")


def mixture(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """The mix itself: doc_id, shard, copy, words, sorted at random within a shard."""
    return laid_out(mix(docs, seed, shards), seed, shards).drop("size")


def mixed_documents(docs: DataFrame, seed: int = 7, shards: int = SHARDS) -> DataFrame:
    """The mix as rows of docs, in the order of mixture().

    A draw of a part of a document has the text up to the end of its last word,
    and n_chars, if docs has that column, counts it.
    """
    tmp = Scratch(docs.sparkSession, "mixing")
    rows = tmp.save(sized(docs), "sized")
    draws = laid_out(drawn(sized(docs, F.expr("struct(*)").alias("row")), plan_sources(rows, seed, shards, tmp), seed, "row"), seed, shards, "row")
    part, text = F.col("words") < F.col("size"), F.col("row")["text"].cast("string")
    taken = F.array_join(F.slice(F.split(text, WORD_END), 1, F.col("words").cast("int")), "")
    cut = {"text": taken, "n_chars": F.length(taken)}
    return draws.select(*[F.when(part, cut[c].cast(kind)).otherwise(F.col("row")[c]).alias(c) if c in cut else F.col("row")[c].alias(c) for c, kind in docs.dtypes])
