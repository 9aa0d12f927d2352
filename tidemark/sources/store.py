"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, a local session (one machine) gets a folder of its own; any other raises an error, as executors
    don't see each other's local files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    # only a path that exists can be marked, so its place is held by an empty folder until it is written
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    fs.delete(at, True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it again.

    A lost executor then costs a re-read and not a second run of what made the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class SnapshotStore:
    """A table kept as numbered Parquet snapshots; the current one is named by a pointer that is written last.

    Writing the same version again (a repeated micro-batch) replaces it whole, so upserts are idempotent.
    """

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        at, fs = self._pointer()
        return max((int(x.getPath().getName()) for x in fs.listStatus(at)), default=None) if fs.exists(at) else None

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def previous(self, version: int) -> DataFrame:
        """The newest snapshot before a version."""
        at, fs = self._pointer()
        older = [v for v in (int(x.getPath().getName()) for x in fs.listStatus(at)) if v < version] if fs.exists(at) else []
        return self.read(max(older)) if older else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        df.to(self.schema).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        at, fs = self._pointer()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.create(path(at, str(version)), True).close()
        # a batch that runs again reads the one before it; nothing reads older ones
        for old in sorted(int(x.getPath().getName()) for x in fs.listStatus(at))[:-2]:
            fs.delete(path(at, str(old)), True)
            fs.delete(path(f"{self.path}/v{old}"), True)


class EpisodeLog:
    """A tracker's episodes: open ones and each vessel's last report as snapshots, closed ones appended batch by batch.

    A batch rewrites what grows with the vessels, never what grows with time. Writing a batch again replaces it whole;
    the snapshot of open episodes is written last and tells which batches count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.open, self.last = (SnapshotStore(spark, f"{path.rstrip('/')}/{n}", s) for n, s in (("open", schemas.EPISODE), ("last", schemas.POSITION)))
        self.spark, self.closed = spark, f"{path.rstrip('/')}/closed"

    def write(self, batch: int, episodes: DataFrame, last: DataFrame | None = None) -> None:
        """episodes: those open after the batch and those that it closed; last: reports that replace the batch's before."""
        closed = episodes.where("tsOut IS NOT NULL").to(schemas.EPISODE)
        closed.write.mode("overwrite").parquet(f"{self.closed}/batch={batch}")
        if last is not None:
            self.last.write(last, batch)
        self.open.write(episodes.where("tsOut IS NULL"), batch)

    def read(self) -> DataFrame:
        """All episodes, open and closed."""
        version = self.open.version()
        if version is None:
            return self.open.read()
        closed = self.spark.read.parquet(self.closed)
        return self.open.read(version).unionByName(closed.where(F.col("batch") <= version).drop("batch"))
