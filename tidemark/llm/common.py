"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import fresh_path, shared_folder, stored

__all__ = ["fresh_path", "shared_folder", "stored"]

#: Bytes that part words and pad lines: \x20 and \x09-\x0D.
SPACE = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
NOT_SPACE_CLASS = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Queries of texts take batches of BATCH bytes, unless the session sets a size of its own."""
    if spark.conf.get(_BATCH_BYTES, None) in ("67108864b", "64MB"):
        spark.conf.set(_BATCH_BYTES, f"{BATCH}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows from which on a table of few row groups is spread.
LEAST_SPREAD = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; if fewer tasks hold its rows than there are cores, rows are dealt to as many.

    Only a small table has few row groups. Finding out reads no column.
    """
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    held = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("rows")).first()
    return docs.repartition(cores) if held.tasks < cores and (held.rows or 0) >= LEAST_SPREAD else docs


#: A value held by more than one in so many rows is joined by itself; there are fewer such values than this.
HOT = 2_000


def join_apart(rows: DataFrame, values: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined with values, which say in column n how many of the total rows hold each of them; n is dropped.

    Values held by more than a HOT-th of all rows, of which there are fewer than HOT, are sent to the rows; only the
    others deal rows out by value, so no task gets a hot value's rows.
    """
    most = max(1, total // HOT)
    hot = F.broadcast(values.where(F.col(n) > most))
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(values.where(F.col(n) <= most), on)).drop(n)


#: Rows of a key from which on it may be hot.
LEAST_HOT = 1_000


def join_unique(rows: DataFrame, values: DataFrame, on: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with values, which has each key once; rows are cheap to read twice.

    The HOT most frequent keys of at least LEAST_HOT rows are sent to the rows with their values; any other key holds
    less than a HOT-th of all rows. counts: on and n, the rows of each key, if they are known already.
    """
    counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*on, "n")
    hot = stored(counts.where(F.col("n") >= LEAST_HOT).orderBy(F.desc("n"), *on).limit(HOT).select(on), "hot-keys")
    if hot.isEmpty():
        return rows.join(values, on, how)
    apart = rows.join(F.broadcast(F.broadcast(hot).join(values, on, how)), on)
    return apart.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(values, on, how))


#: Bytes of text that a task takes up at once; a longer text is taken up alone.
SLICE = 1 << 20
#: Bytes of a batch on its way to Python, where the session leaves Spark's 64 MB.
BATCH = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_slices(parts: Iterator[pa.RecordBatch], at: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices with about `most` bytes of text in column `at`, at least one row in each.

    What is made of a text takes many times its bytes, so memory is bounded by bytes and not by rows. At the end what
    Arrow keeps for later is given back, as a worker lives on and serves other stages.
    """
    for part in parts:
        if part.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(at)), 0).to_numpy().astype(np.int64))
            cuts = [0, *(np.nonzero(np.diff(ends // most))[0] + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield part.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one character: printable Latin-1 ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def id_crc32(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
