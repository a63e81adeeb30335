"""Readers and writers of agent records.

Schemas are always given, never inferred: optional keys differ from file to
file. Rows that do not parse are dropped by `valid` and counted by `rejected`;
nothing is read on the driver.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from . import schemas
from .positions import positioned

CORRUPT = "_corrupt_record"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
#: Below this size on disk a table may have fewer splits than there are cores.
SMALL_BYTES = 32 << 20


def json_files(spark: SparkSession, path: str, schema: str, recursive: bool = True) -> DataFrame:
    """One JSON object, or an array of them, in each file; with the file's name for ordering."""
    return scanned(spark, path, schema, recursive).withColumn("file", file_name(spark, path))


def scanned(spark: SparkSession, path: str, schema: str, recursive: bool = True) -> DataFrame:
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", recursive).json(path)


def file_name(spark: SparkSession, path: str) -> Column:
    """The path of a scanned row's file below the folder that was asked for; of a single file, its name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), SCHEME, "")
    below = re.sub(SCHEME, "", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(below)), F.substring(plain, F.lit(len(below) + 1), F.length(plain))).otherwise(F.element_at(F.split(plain, "/"), -1))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as VARIANT `document`, null where a file is no JSON, with the file's path."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return df.select(file_name(spark, path).alias("file"), F.try_parse_json("value").alias("document"))


def json_schema(path: str) -> dict:
    """A JSON Schema from a file, for functions.json_schema."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object in each line; blank lines are skipped."""
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table of few files, dealt to all cores for work that is heavy for its size.

    A row group is read by one task, so one such file would keep one core busy.
    Tables of SMALL_BYTES or more have splits of their own, and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df


def valid(df: DataFrame) -> DataFrame:
    """The rows that parse. A reader may not be asked for the corrupt record alone, as a plain count would: a column goes with it."""
    plain = next((c for c, kind in df.dtypes if c not in (CORRUPT, "file") and not kind.startswith(("map", "struct", "array", "variant"))), None)
    with_it = F.hash(F.col(f"`{plain}`")) >= F.lit(-(1 << 31)) if plain else F.lit(True)  # true of all rows
    return df.where(F.col(CORRUPT).isNull() & with_it).drop(CORRUPT)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull())


def traces(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.TRACE))


def runs(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.RUN))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.SESSION))


def rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """Signature rules as data; operators.monitor.rules_of makes rules of them."""
    return valid(json_files(spark, path, schemas.RULE))


def monitor_results(spark: SparkSession, path: str) -> DataFrame:
    """The events of saved monitor results."""
    return valid(json_files(spark, path, f"events ARRAY<STRUCT<{schemas.MONITOR_EVENT}>>")).select(F.explode("events").alias("e")).select("e.*")


def query_config(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.QUERY_CONFIG))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.NODE))


def step_graphs(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.STEP_GRAPH))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.SCENARIO))


def detonations(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_lines(spark, path, schemas.DETONATION))


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_lines(spark, path, schemas.OUTCOME))


def cases(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Benchmark cases of several splits, each from its own path, under one set of names; case_index counts a split's cases in file order, from 0."""
    out = None
    for split, path in paths.items():
        df = valid(positioned(scanned(spark, path, schemas.CASE), "case_index")).select(
            F.lit(split).alias("split"), F.col("User Instruction").alias("user_instruction"), F.col("User Tool").alias("user_tool"), F.col("Tool Response").alias("tool_response"),
            F.col("Attacker Tools").alias("attacker_tools"), F.col("Attack Type").alias("attack_type"), "case_index",
        )
        out = df if out is None else out.unionByName(df)
    return out


def patch_cases(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.PATCH_CASE))


def benchmark_runs(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.BENCH_RUN))


def signals(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.SIGNAL))


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.HYPOTHESIS))


def deltas(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.DELTA))


def risks(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_files(spark, path, schemas.RISK))


def labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_lines(spark, path, schemas.LABELLED))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    return valid(json_lines(spark, path, schemas.EVAL_CASE))


def curated_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def risk_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGISTER).option("header", True).csv(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


ATOM = f"id STRING, title STRING, summary STRING, published STRING, updated STRING, link ARRAY<STRUCT<_href: STRING, _rel: STRING>>, {CORRUPT} STRING"


def atom_entries(spark: SparkSession, path: str, keep_rejected: bool = False, split: bool = False) -> DataFrame:
    """The entries of Atom feeds, one row each: entry_id, title, summary, published, updated, link (the last alternate one, else the first).

    Prefixes, CDATA and entities are the XML reader's matter. A file is one
    task's, unless split: then a large one is cut behind each `</entry>`, which
    must not occur in texts, by all cores. (The XML reader's own way of splitting
    loses an entry that follows another without white space.) An entry that does
    not parse is kept in _corrupt_record if asked for.
    """
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if split:
        body = F.regexp_extract("value", r"(?s)<entry[\s>].*$", 0)
        pieces = spark.read.option("lineSep", "</entry>").text(path).where(body != "")
        df = pieces.select(F.from_xml(F.concat(body, F.lit("</entry>")), ATOM, options).alias("e")).select("e.*")
    else:
        df = spark.read.format("xml").options(**options).option("rowTag", "entry").schema(ATOM).load(path)
    linked = F.filter("link", lambda x: F.coalesce(x["_href"], F.lit("")) != "")
    link = F.coalesce(F.try_element_at(F.filter(linked, lambda x: x["_rel"] == "alternate"), F.lit(-1))["_href"], F.try_element_at(linked, F.lit(1))["_href"], F.lit(""))
    day = lambda c: F.substring(clean(F.col(c)), 1, 10).alias(c)
    rows = df.select(clean(F.col("id")).alias("entry_id"), clean(F.col("title")).alias("title"), clean(F.col("summary")).alias("summary"), day("published"), day("updated"), link.alias("link"), CORRUPT)
    return rows if keep_rejected else valid(rows)


def posts_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts and their authors from saved search payloads."""
    post = "STRUCT<id: STRING, author_id: STRING, text: STRING, created_at: STRING>"
    user = "STRUCT<id: STRING, username: STRING, name: STRING>"
    df = valid(json_files(spark, path, f"data ARRAY<{post}>, includes STRUCT<users: ARRAY<{user}>>"))
    items = df.select(F.explode("data").alias("p")).select(F.col("p.id").alias("event_id"), F.col("p.author_id").alias("author_id"), F.col("p.text").alias("text"), F.substring("p.created_at", 1, 10).alias("created_at"))
    users = df.select(F.explode("includes.users").alias("u")).select(F.col("u.id").alias("author_id"), F.col("u.username").alias("username")).dropDuplicates(["author_id"])
    return items, users


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """Of rows that share a key, the one that comes first in hash order; equal keys are folded before they are shuffled."""
    order = F.xxhash64(F.to_json(F.struct("*")))
    chosen = df.select(F.col(key).alias("key__"), F.struct("*").alias("row__"), order.alias("order__")).groupBy("key__").agg(F.min_by("row__", "order__").alias("row__"))
    return chosen.select("row__.*")


def append_once(df: DataFrame, path: str, key: str, batch: str) -> DataFrame:
    """Appends, as lines of JSON, one row of each key that no other batch has; gives these rows.

    A batch has a folder of its own below path, which it replaces: what is
    appended again under the same name, after a failure or by a retry, is there once.
    """
    spark, fields, own = df.sparkSession, df.schema, f"batch={batch}"
    new = one_of_each(df, key)
    if exists(spark, path):
        have = spark.read.schema(f"{fields.toDDL()}, batch STRING").json(path)
        new = new.join(have.where(F.col("batch") != batch).select(key).distinct(), key, "left_anti").select(*fields.names)
    new.write.mode("overwrite").json(f"{path}/{own}")
    return spark.read.schema(fields).json(f"{path}/{own}")


def read_through(spark: SparkSession, path: str, build) -> DataFrame:
    """A kept table, built and written where it is not there yet."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Line-delimited JSON; with partition_by, one folder for each value."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
