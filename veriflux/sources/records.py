"""One file for each record, named by its key, committed as a whole.

A Python data source: a task writes its records under a folder of its own
attempt; only what committed attempts wrote is moved to its place when the job
ends, and the rest goes. The batch then has a marker: writing the same batch
again changes nothing. For reports and traces that people or other tools open one
by one, not for tables.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .readers import one_of_each

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Folder(WriterCommitMessage):
    def __init__(self, name: str, n: int):
        self.name, self.n = name, n


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.uri, self.batch, self.suffix = options["path"], options["batch"], options.get("suffix", ".json")

    def place(self):
        files, root = fs.FileSystem.from_uri(self.uri)
        return files, root.rstrip("/"), f"{root.rstrip('/')}/_writing-{quote(self.batch, safe='')}", f"{root.rstrip('/')}/_batch-{quote(self.batch, safe='')}"

    def write(self, iterator: Iterator[Row]) -> Folder:
        files, _, writing, marker = self.place()
        folder, n = f"{writing}/{uuid.uuid4().hex}", 0
        if files.get_file_info(marker).type == fs.FileType.NotFound:
            for key, body in iterator:
                if not n:
                    files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{quote(key, safe='')}{self.suffix}") as file:
                    file.write((body + "\n").encode())
                n += 1
        return Folder(folder, n)

    def commit(self, messages: list[Folder | None]) -> None:
        files, root, writing, marker = self.place()
        if files.get_file_info(marker).type != fs.FileType.NotFound:
            return
        done = [m for m in messages if m and m.n]
        names = [x.path for m in done for x in files.get_file_info(fs.FileSelector(m.name))]
        with ThreadPoolExecutor(16) as pool:  # a move is a request to the store, not a copy
            list(pool.map(lambda path: files.move(path, f"{root}/{path.rsplit('/', 1)[-1]}"), names))
        self.clear(files, writing)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(marker) as file:
            file.write(f"{sum(m.n for m in done)}\n".encode())

    def abort(self, messages: list[Folder | None]) -> None:
        files, _, writing, _ = self.place()
        self.clear(files, writing)

    @staticmethod
    def clear(files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


class RecordFiles(DataSource):
    """Options: path, batch, suffix. Rows are (key, body)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "key string, body string"

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options))


def write_records(df: DataFrame, path: str, key: str, batch: str, suffix: str = ".json") -> None:
    """A JSON file below path for each row, named by its key; of rows that share one, a single one is written.

    A file that another batch left under the same key is replaced. A null key is an error.
    """
    df.sparkSession.dataSource.register(RecordFiles)
    named = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit(f"a record has no {key}")).cast("string"))
    rows = one_of_each(df, key).select(named.alias("key"), F.to_json(F.struct("*")).alias("body"))
    rows.write.format("record_files").option("path", path).option("batch", batch).option("suffix", suffix).mode("append").save()
