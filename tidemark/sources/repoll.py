"""A table of reports that is polled again and again for what is newer than the newest report read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .schemas import POSITION

NAME = "repolled_positions"
_START = {"ts": -(1 << 62), "event_id": -(1 << 62)}


class Groups(InputPartition):
    """Row groups of one file that may hold reports after one offset and up to another."""

    def __init__(self, path: str, groups: list[int], after: dict, upto: dict):
        self.path, self.groups, self.after, self.upto = path, groups, after, upto


def _time(micros: int) -> pa.Scalar:
    return pa.scalar(micros, pa.timestamp("us"))


def _newer(offset: dict) -> ds.Expression:
    """Reports after an offset, by (ts, event_id)."""
    if offset["ts"] == _START["ts"]:
        return ds.field("ts").is_valid()
    return (ds.field("ts") > _time(offset["ts"])) | ((ds.field("ts") == _time(offset["ts"])) & (ds.field("event_id") > offset["event_id"]))


class RepollReader(DataSourceStreamReader):
    """Offsets are the newest (ts in microseconds, event_id) read; a batch is what lies between two of them.

    Only the row groups whose statistics reach beyond the last offset are opened, on the driver for two columns to find
    the newest report, and in tasks, one for each file, for the rows.
    """

    def __init__(self, path: str):
        self.path = path
        self.known = dict(_START)

    def _table(self) -> tuple[fs.FileSystem, ds.Dataset | None]:
        where, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        files = [x.path for x in where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if x.is_file and x.path.endswith(".parquet")]
        return where, ds.dataset(sorted(files), format="parquet", filesystem=where) if files else None

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        _, table = self._table()
        best = (self.known["ts"], self.known["event_id"])
        if table is not None:
            for batch in table.scanner(columns=["ts", "event_id"], filter=_newer(self.known)).to_batches():
                if batch.num_rows:
                    times, ids = batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(), batch.column("event_id").to_numpy()
                    newest = int(times.max())
                    best = max(best, (newest, int(ids[times == newest].max())))
        self.known = {"ts": best[0], "event_id": best[1]}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Groups]:
        if start == end:
            return []
        _, table = self._table()
        wanted = _newer(start) & ~_newer(end)
        out = []
        for fragment in table.get_fragments() if table is not None else []:
            groups = [g.row_groups[0].id for g in fragment.split_by_row_group(wanted)]
            if groups:
                out.append(Groups(fragment.path, groups, start, end))
        return out

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), None)
        fragment = ds.ParquetFileFormat().make_fragment(partition.path, filesystem=where, row_groups=partition.groups)
        for batch in fragment.scanner(columns=POSITION.names, filter=_newer(partition.after) & ~_newer(partition.upto)).to_batches():
            if batch.num_rows:
                yield batch

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end, key=lambda o: (o["ts"], o["event_id"]))

    def stop(self) -> None:
        pass


class RepolledPositions(DataSource):
    """Streaming source of reports in a growing folder of Parquet files; option path: a folder that driver and executors reach by pyarrow."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return POSITION

    def streamReader(self, schema) -> RepollReader:
        return RepollReader(self.options["path"])


def repoll_positions(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the reports (ts as a timestamp) of a table that others append to, each once, by high-water mark.

    A restart from a checkpoint goes on after the newest report read, so nothing is lost or repeated. A report that is
    appended later but is not newer than the newest one read, by (ts, event_id), is not read; nor are those without ts
    or event_id. A table without files yet is an empty stream.
    """
    spark.dataSource.register(RepolledPositions)
    return spark.readStream.format(NAME).option("path", path).load().withColumn("ts", F.col("ts").cast("timestamp"))
