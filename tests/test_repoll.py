"""The re-polling source: offsets, restarts, and what is opened."""

from datetime import datetime, timedelta

import pytest

from tidemark.sources import repoll
from tidemark.sources.schemas import POSITION
from tidemark.streaming import trackers

T0 = datetime(2024, 1, 1)


def append(spark, path, reports):
    """reports: (event_id, minute)."""
    rows = [tuple({"event_id": i, "ts": None if m is None else T0 + timedelta(minutes=m), "mmsi": 1 + i % 3, "longitude": 1.0 * i}.get(f.name) for f in POSITION) for i, m in reports]
    spark.createDataFrame(rows, POSITION).coalesce(1).write.mode("append").parquet(path)


def test_restarts_neither_lose_nor_repeat(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("table", "out", "checkpoint"))

    def run():
        trackers.run_available(repoll.repoll_positions(spark, path), checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}"), "append")
        return sorted(r.event_id for r in spark.read.parquet(out).collect())

    append(spark, path, [(i, i) for i in range(20)])
    assert run() == list(range(20))
    assert run() == list(range(20))  # nothing new
    # of one time as the newest one read: a larger id is new; older reports and those without a time are not
    append(spark, path, [(20, 19), (21, 30), (100, 5), (101, None)])
    append(spark, path, [(i, i + 20) for i in range(22, 40)])
    assert run() == list(range(40))


def test_offsets_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "table")
    reader = repoll.RepollReader(path)
    assert reader.latestOffset() == reader.initialOffset()
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    append(spark, path, [(i, i) for i in range(5)])
    first = reader.latestOffset()
    append(spark, path, [(i, i) for i in range(5, 9)])
    second = reader.latestOffset()
    assert first["ts"] < second["ts"]
    assert len(reader.partitions(first, second)) == 1 and len(reader.partitions(reader.initialOffset(), second)) == 2
    ids = lambda a, b: sorted(i for p in reader.partitions(a, b) for batch in reader.read(p) for i in batch.column("event_id").to_pylist())
    assert ids(first, second) == [5, 6, 7, 8] and ids(reader.initialOffset(), first) == [0, 1, 2, 3, 4] and ids(second, second) == []
    # a reader that begins anew finds the same end and goes on from a stored offset
    again = repoll.RepollReader(path)
    again.commit(first)
    assert again.latestOffset() == second


def test_failing_table(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="Parquet|parquet"):
        repoll.RepollReader(str(tmp_path)).latestOffset()
