"""Tables in the folder that all executors share: lineage ends at them, and a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a private one where that is unset.

    A temporary folder is made only for a local master; a cluster without
    spark.checkpoint.dir is an error, since executors could not see the files.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if set_before := spark.sparkContext.getCheckpointDir():
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="veriflux-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


class Scratch:
    """Tables written under the shared folder.

    What is left of them goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def path(self, name: str = ""):
        """A Hadoop path, and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        if not self.marked:
            root, files = self.path()
            self.marked = files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self.path(name)
            files.delete(path, True)

    def keep(self, *kept: str) -> None:
        """Drops all tables but these."""
        root, files = self.path()
        self.drop(*(x.getPath().getName() for x in files.listStatus(root) if x.getPath().getName() not in kept))
