"""Live sources: pages of JSON, XML or HTML by address, read by Spark tasks.

`fetched` is a Python data source: an address is one partition's, at most
`PARTITIONS` of them share the addresses, and the driver reads none. A task tries
an address three times, and keeps what it got in a cache folder, which is then
read instead, so a run that is repeated, or a task that is, asks for nothing
twice. Query strings of the sources that are asked by query are built here,
with page sizes held within each source's limits.
"""

from __future__ import annotations

import hashlib
import json
import sys
import time
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a cluster's workers need no copy of this package

PARTITIONS = 256
RETRIES, DELAY, TIMEOUT = 3, 2.0, 30.0
AGENT = "veriflux/1.0"
FETCHED = "address string, body string, attempts int, error string"

# The sources' addresses, parameters and limits.
LOOKUP = "https://incidentdatabase.ai/api/lookupbyurl"
FEED = "https://export.arxiv.org/api/query"
POSTS, LIST_POSTS = "https://api.x.com/2/tweets/search/recent", "https://api.x.com/2/lists/{}/tweets"
POST_FIELDS = {"tweet.fields": "created_at,author_id,public_metrics,possibly_sensitive,lang,entities", "expansions": "author_id", "user.fields": "username,name,verified"}
SEARCH_PAGE, LIST_PAGE = (10, 100), (5, 100)
# End of fixed values.


def within(n: int, limits: tuple[int, int]) -> int:
    return max(limits[0], min(n, limits[1]))


def lookup_address(url: str, base: str = LOOKUP) -> str:
    return f"{base}?{urlencode({'url': url})}"


def feed_address(query: str, max_results: int = 5, start: int = 0, base: str = FEED) -> str:
    return f"{base}?{urlencode({'search_query': query, 'start': start, 'max_results': max_results, 'sortBy': 'submittedDate', 'sortOrder': 'descending'})}"


def posts_address(query: str, max_results: int = 10, base: str = POSTS) -> str:
    return f"{base}?{urlencode({'query': query, 'max_results': within(max_results, SEARCH_PAGE), **POST_FIELDS})}"


def list_address(list_id: str, max_results: int = 10, base: str = LIST_POSTS) -> str:
    return f"{base.format(list_id)}?{urlencode({'max_results': within(max_results, LIST_PAGE), **POST_FIELDS})}"


class Share(InputPartition):
    def __init__(self, addresses: list[str]):
        self.addresses = addresses


class Cache:
    """Bodies by the hash of their address, in a folder that all tasks share; a body is there whole or not at all."""

    def __init__(self, folder: str | None):
        self.files, self.folder = fs.FileSystem.from_uri(folder) if folder else (None, "")

    def path(self, address: str) -> str:
        return f"{self.folder}/{hashlib.sha256(address.encode()).hexdigest()}"

    def get(self, address: str) -> str | None:
        if not self.files or self.files.get_file_info(self.path(address)).type == fs.FileType.NotFound:
            return None
        with self.files.open_input_file(self.path(address)) as file:
            return file.read().decode("utf-8", "replace")

    def put(self, address: str, body: str) -> None:
        if self.files:
            self.files.create_dir(self.folder, recursive=True)
            draft = f"{self.path(address)}.{time.time_ns()}"
            with self.files.open_output_stream(draft) as file:
                file.write(body.encode())
            self.files.move(draft, self.path(address))


class AddressReader(DataSourceReader):
    def __init__(self, options: dict):
        self.addresses = json.loads(options["addresses"])
        self.cache, self.token = options.get("cache"), options.get("token")
        self.retries, self.delay, self.timeout = int(options.get("retries", RETRIES)), float(options.get("delay", DELAY)), float(options.get("timeout", TIMEOUT))
        self.strict = options.get("strict", "true") == "true"

    def partitions(self) -> list[Share]:
        n = min(PARTITIONS, len(self.addresses))
        return [Share(self.addresses[i::n]) for i in range(n)] or [Share([])]

    def fetch(self, address: str) -> tuple:
        error = None
        for attempt in range(1, self.retries + 1):
            if attempt > 1:
                time.sleep(self.delay)
            try:
                headers = {"User-Agent": AGENT} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
                with urlopen(Request(address, headers=headers), timeout=self.timeout) as response:
                    return response.read().decode("utf-8", "replace"), attempt, None
            except Exception as e:  # noqa: BLE001  whatever failed is tried again, and then told
                error = e
        if self.strict:
            raise RuntimeError(f"{address} could not be read in {self.retries} attempts: {error}")
        return None, self.retries, str(error)

    def read(self, partition: Share) -> Iterator[tuple]:
        cache = Cache(self.cache)
        for address in partition.addresses:
            if (body := cache.get(address)) is not None:
                yield address, body, 0, None
                continue
            body, attempts, error = self.fetch(address)
            if body is not None:
                cache.put(address, body)
            yield address, body, attempts, error


class Addresses(DataSource):
    """Options: addresses (a JSON list), cache, retries, delay, timeout, token, strict (`false`: a failure is a row)."""

    @classmethod
    def name(cls) -> str:
        return "addresses"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> AddressReader:
        return AddressReader(dict(self.options))


def fetched(spark: SparkSession, addresses: list[str], cache: str | None = None, **options) -> DataFrame:
    """address, body, attempts (0: from the cache), error, one row for each address of a list that a configuration holds."""
    spark.dataSource.register(Addresses)
    reader = spark.read.format("addresses").option("addresses", json.dumps(list(dict.fromkeys(addresses))))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return (reader.option("cache", cache) if cache else reader).load()


def is_address(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def json_documents(spark: SparkSession, where: str, cache: str | None = None) -> DataFrame:
    """`document`, a VARIANT, of a JSON file or address; the elements, one a row, where it is an array."""
    whole = fetched(spark, [where], cache).select("body") if is_address(where) else spark.read.text(where, wholetext=True).select(F.col("value").alias("body"))
    d = F.parse_json("body")
    return whole.select(F.explode(F.when(F.startswith(F.trim("body"), F.lit("[")), F.try_variant_get(d, "$", "array<variant>")).otherwise(F.array(d))).alias("document"))


def looked_up(spark: SparkSession, records: DataFrame, base: str = LOOKUP, cache: str | None = None, **options) -> DataFrame:
    """records(url, ...), a list for one session's requests, with result_count: how many incidents the database has for each address."""
    urls = [r.url for r in records.select("url").distinct().toLocalIterator()]
    found = fetched(spark, [lookup_address(u, base) for u in urls], cache, **options)
    asked = spark.createDataFrame([(u, lookup_address(u, base)) for u in urls], "url string, address string")
    results = F.try_variant_get(F.try_parse_json("body"), "$.results", "array<variant>")
    counted = asked.join(found, "address").select("url", F.coalesce(F.size(results), F.lit(0)).cast("long").alias("result_count"))
    return records.join(counted, "url", "left")


def feed_files(spark: SparkSession, queries: list[tuple[str, int]], folder: str, base: str = FEED, **options) -> DataFrame:
    """Fetches a feed for each (query, max_results) into `folder`, which readers.atom_entries reads; what it was asked, for each."""
    return fetched(spark, [feed_address(q, n, base=base) for q, n in queries], cache=folder, **options).select("address", "attempts", "error")


def posts_and_users(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Posts and their authors from search payloads held as text."""
    d: Column = F.from_json(body, "data ARRAY<STRUCT<id: STRING, author_id: STRING, text: STRING, created_at: STRING>>, includes STRUCT<users: ARRAY<STRUCT<id: STRING, username: STRING>>>")
    p = bodies.select(d.alias("d"))
    items = p.select(F.explode("d.data").alias("p")).select(F.col("p.id").alias("event_id"), "p.author_id", "p.text", F.substring("p.created_at", 1, 10).alias("created_at"))
    users = p.select(F.explode("d.includes.users").alias("u")).select(F.col("u.id").alias("author_id"), "u.username").dropDuplicates(["author_id"])
    return items, users
