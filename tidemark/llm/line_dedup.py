"""Dropping lines that many documents share, with levelled sorted runs of line hashes.

Documents arrive in batches. A batch's distinct line keys are counted, merge-anti-joined with the keys that each run has
already settled (counted in enough documents), and the rest becomes a new run. Runs are tables bucketed and sorted by
hash, so joining with one moves and sorts only the batch. When a level holds FANOUT runs they are merged, bucket by
bucket, into one run of the next level. At the end all runs are merged once more, and the keys whose count reaches the
limit lose their lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh_path, join_apart, stored, table, text_bytes, text_slices

#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Batches into which a whole table is dealt.
BATCHES = 4
#: Settled keys that are sent to all tasks (about 100 bytes each, in a set); with more of them the keys are joined to documents.
MOST_SENT = 1 << 17


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and their keys."""
    lines = text.split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets of one file each count as sorted, as they were written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs (h1, h2, n): 128-bit line hash and number of documents, each bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        self.tables.append(f"line_run_{uuid.uuid4().hex}")
        path = fresh_path(self.spark, "line-run")
        with _sorted_scans(self.spark):
            counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        whole, *others = runs
        for run in others:
            both = whole.withColumnRenamed("n", "a").join(run.withColumnRenamed("n", "b").hint("merge"), ["h1", "h2"], "full_outer")
            whole = both.select("h1", "h2", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))
        return whole

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, one row for each document and distinct key in it."""
        new = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        for run in (run for level in self.levels for run in level):
            settled = run.where(F.col("n") >= self.min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            # with n in the condition the join stays above the sums, so that a frequent line is summed before it is moved
            new = new.join(settled.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("n") > 0), "left_anti")
        self.levels[0].append(self._write(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(self.levels[level])))
            self.levels[level] = []
            level += 1

    def settled(self) -> DataFrame:
        """Keys counted in at least min_docs documents, with n, stored apart from the runs."""
        runs = [run for level in self.levels for run in level]
        with _sorted_scans(self.spark):
            return stored(self._merged(runs).where(F.col("n") >= self.min_docs), "settled")

    def drop(self) -> None:
        """Takes the runs out of the catalogue; what settled() gave stays."""
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")


def _hash_lines(docs: DataFrame, text: str, key: str, least: int, batches: int) -> DataFrame:
    """key, h1, h2, batch: one row for each document and distinct line key of at least `least` code points."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            row: list[int] = []
            found: list[bytes] = []
            for i, t in enumerate(text_bytes(part.column(1))):
                keys = {k for k in line_keys(t)[1] if k}
                if least > 1:
                    keys = {k for k in keys if len(k.decode()) >= least}
                row += [i] * len(keys)
                found += map(xxhash.xxh3_128_digest, keys)
            both = np.frombuffer(b"".join(found), dtype=">i8").reshape(-1, 2)
            yield pa.record_batch(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64)), part.column(2).take(pa.array(row, pa.int64()))],
                names=["id", "h1", "h2", "batch"],
            )

    source = docs.select(F.col(key), F.col(text).cast("string"), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    return source.mapInArrow(run, f"id {dict(docs.dtypes)[key]}, h1 long, h2 long, batch int")


def _keep(text: bytes, dropped) -> tuple[bytes, int, int]:
    lines, keys = line_keys(text)
    kept = [line for line, k in zip(lines, keys, strict=True) if not k or xxhash.xxh3_128_digest(k) not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _apply(frame: DataFrame, columns: list[str], text: str, dropped) -> DataFrame:
    """Replaces text by its kept lines and adds n_lines, n_dropped. dropped: a broadcast set, or a column's name."""
    from pyspark.sql import types as T

    names = frame.columns
    schema = T.StructType([frame.schema[c] for c in columns]).add("n_lines", "long").add("n_dropped", "long")
    at = names.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, at):
            texts = part.column(at).cast(pa.binary()).to_pylist()
            if isinstance(dropped, str):
                sets = [set(x or ()) for x in part.column(names.index(dropped)).to_pylist()]
            else:
                sets = [dropped.value] * len(texts)
            done = [_keep(t or b"", s) for t, s in zip(texts, sets, strict=True)]
            kept = pa.array([None if t is None else d[0] for t, d in zip(texts, done, strict=True)], pa.binary()).cast(pa.string())
            arrays = [kept if c == text else part.column(names.index(c)) for c in columns]
            yield pa.record_batch([*arrays, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return frame.mapInArrow(run, schema)


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, least: int = 1, batches: int = BATCHES, most_sent: int = MOST_SENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with text holding only its kept lines, and n_lines (before) and n_dropped.

    A line's key is the line stripped of white space, A-Z in lower case; keys of at least `least` code points found in
    at least min_docs rows lose all their lines. Keys are compared by 128-bit hashes. Null texts count as one empty
    line and stay null; empty keys are never dropped; each row counts as a document, also with a repeated or null id.
    Other columns pass through, but for two of these names, which are replaced. An empty table gives no rows.
    """
    from .common import without

    spark = docs.sparkSession
    docs = without(docs, ["n_lines", "n_dropped"])
    columns = docs.columns
    lines = stored(_hash_lines(docs, text, key, least, batches), "lines")
    runs = LineRuns(spark, min_docs)
    try:
        for b in range(batches):
            runs.add(lines.where(F.col("batch") == b).select("h1", "h2"))
        settled = runs.settled()
    finally:
        runs.drop()
    if settled.count() <= most_sent:
        digests = {np.array([r.h1, r.h2], dtype=">i8").tobytes() for r in settled.toLocalIterator()}
        return _apply(docs, columns, text, spark.sparkContext.broadcast(digests))
    # too many for one table in each task: give each document the settled keys among its own
    packed = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("h1", "h2")])
    own = join_apart(lines, settled, ["h1", "h2"], lines.count()).groupBy("id").agg(F.collect_set(packed).alias("__dropped"))
    return _apply(docs.join(own, F.col(f"`{key}`").eqNullSafe(own["id"]), "left").drop(own["id"]), columns, text, "__dropped")


def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_shared_lines(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT lines.*, key IN (SELECT key FROM shared) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
