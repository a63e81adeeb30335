"""A corpus pipeline over `documents`, stage by stage; counted with veriflux.llm.

Each stage works on all its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriflux.llm import exact_dedup, minhash, mixing, packing, toxicity
from veriflux.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; clean ones all stay.

    Each row is judged by its whole text alone, so repeated rows and rows with a
    null doc_id share the verdict of their text, and a null or empty text has the
    score of a text without known words. Other columns, whatever their names,
    pass through. Without labels of both classes the score is that of the one
    class, or near 0. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case; null counts as empty), the row with the largest doc_id.

    Exactly one row of each class stays: of repeated rows with that doc_id, or of
    a class without any doc_id, the first in hash order. Long texts are compared
    by all their bytes. Other columns pass through. An empty table gives no rows.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the smallest doc_id.

    Null and empty texts link with nothing and stay, and so do rows with a null
    doc_id. Repeated rows (one doc_id or none, and equal sets) leave one, the first
    in hash order. Other columns pass through. An empty table gives no rows.
    """
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of the mix, laid out by shard and shuffled within it; the one at which a source's target ends has the words that are left.

    A null source is one of its own and comes last; a document without words is
    taken as often as its source's others, and a source without words not at all.
    Rows that tie at the end of a target share what is left of it. Other columns
    pass through; n_chars counts a cut text. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024, as op8_packing gives them.

    A null or empty text is its end mark alone. Repeated rows and null doc_ids are
    packed like any other; other columns do not go on. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tmp, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = tmp.save(stage(spark, docs, sf_dir), name)
        if before:
            tmp.drop(before)
        before = name
    return docs
