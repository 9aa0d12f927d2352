import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes as E
from tidemark.operators.proximity import proximity_pairs
from tidemark.plans import sts as S
from tidemark.plans import views as W
from tidemark.sources import io
from tidemark.sources.schemas import EPISODE, POSITION, ZONE
from tidemark.sources.store import SnapshotStore
from tidemark.sources.zones import zone_row
from tidemark.streaming import trackers as T

T0 = datetime(2024, 1, 1)
INSIDE, OUTSIDE, FAR = (104.7, 2.0), (104.5, 2.0), (100.0, 10.0)


def position(i, mmsi, place, minutes=None, status=0):
    return ("A", i, T0 + timedelta(minutes=i if minutes is None else minutes), mmsi, status, f"s{status}", place[0], place[1], 0.0, float(i), 0.1 * i, 0.0)


@pytest.fixture
def restricted(spark):
    from tidemark.sources.zones import zone_catalog

    return zone_catalog(spark, (0,))


def model(rows, inside):
    """The state machine, one row at a time."""
    done, opened = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        mmsi, at = r[3], r[2]
        if inside(r):
            e = opened.setdefault(mmsi, {"mmsi": mmsi, "in": at, "status": r[4], "out": None})
            e |= {"last": at, "lon": r[6]}
        elif mmsi in opened:
            done.append(opened.pop(mmsi) | {"out": at})
    return sorted([(e["mmsi"], e["in"], e["last"], e["out"], e["status"], e["lon"]) for e in [*done, *opened.values()]], key=repr)


def rows_of(df):
    return sorted([(r.mmsi, r.tsDetected, r.tsCurrent, r.tsOut, r.navStatus, r.longitude) for r in df.collect()], key=repr)


def test_out_in_in_out_in(spark, restricted):
    rows = [position(i, 1, p, status=i) for i, p in enumerate([OUTSIDE, INSIDE, INSIDE, OUTSIDE, INSIDE])]
    got = rows_of(E.zone_episodes(spark.createDataFrame(rows, POSITION), restricted))
    assert [(x[1].minute, x[2].minute, x[3] and x[3].minute, x[4]) for x in got] == [(1, 2, 3, 1), (4, 4, None, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_equal_state_machine_and_stream(spark, restricted, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [position(i, rnd.randrange(4), rnd.choice([INSIDE, OUTSIDE]), i // 2, rnd.randrange(9)) for i in range(120)]
    want = model(rows, lambda r: r[6] == INSIDE[0])
    df = spark.createDataFrame(rows, POSITION)
    assert rows_of(E.zone_episodes(df, restricted)) == want
    # the same in micro-batches, each of a later file
    log, write = T.episode_sink(spark, f"file://{tmp_path}/episodes", (0,))
    for k in range(3):
        # several files in each batch, which repeats the last five reports of the one before
        df.where((F.col("event_id") >= 40 * k - 5) & (F.col("event_id") < 40 * k + 40)).write.mode("append").parquet(f"{tmp_path}/in")
        T.run_available(io.stream_positions(spark, f"{tmp_path}/in"), f"file://{tmp_path}/checkpoint", write, "append")
    assert rows_of(log.read()) == want
    again = log.last.read().collect()
    write(spark.createDataFrame(df.where("event_id >= 80").collect(), POSITION), 2)  # the last batch once more
    assert rows_of(log.read()) == want and sorted(log.last.read().collect()) == sorted(again)
    write(df.limit(0), 3)
    assert rows_of(log.read()) == want
    assert len(list((tmp_path / "episodes" / "open").glob("v*"))) == 2  # older snapshots are gone


def test_null_coordinates_and_empty_tables(spark, restricted):
    rows = [position(0, 1, (None, 2.0)), position(1, 1, (float("nan"), 2.0)), position(2, 1, INSIDE)]
    assert E.zone_episodes(spark.createDataFrame(rows, POSITION), restricted).count() == 1
    assert E.zone_episodes(spark.createDataFrame([], POSITION), restricted).count() == 0


def test_many_zones_at_once(spark):
    square = lambda z, x: zone_row(z, str(z), "x", [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0), (x, 0.0)])
    zones = spark.createDataFrame([square(1, 0.0), square(2, 1.0)], ZONE)
    rows = [position(i, 1, (x, 1.0)) for i, x in enumerate([0.5, 1.5, 2.5, 1.5])]
    got = E.zone_episodes(spark.createDataFrame(rows, POSITION), zones).collect()
    assert sorted((r.zone, r.tsDetected.minute, r.tsOut and r.tsOut.minute) for r in got if r.zone == 1) == [(1, 0, 2), (1, 3, None)]
    assert [(r.tsDetected.minute, r.tsOut) for r in got if r.zone == 2] == [(1, None)]


def episode(mmsi, since, current=None, out=None, **more):
    base = {"id": None, "tsDetected": since, "tsCurrent": current or since, "tsOut": out, "mmsi": mmsi, "navStatus": 1, "navStatusDesc": "x", "longitude": 104.7, "latitude": 2.0, "rot": 0.0, "cog": 0.0, "sog": 0.0, "trueHeading": 0.0, "zone": 0} | more
    return tuple(base[c] for c in EPISODE.names)


def test_newest_open_and_stale(spark):
    as_of = T0 + timedelta(days=6)
    episodes = spark.createDataFrame([episode(1, T0), episode(1, T0 + timedelta(hours=1)), episode(2, T0), episode(2, T0 - timedelta(days=1), out=T0), episode(3, T0 + timedelta(days=3))], EPISODE)
    assert sorted((r.mmsi, r.tsDetected) for r in E.newest_open(episodes).collect()) == [(1, T0 + timedelta(hours=1)), (2, T0), (3, T0 + timedelta(days=3))]
    positions = spark.createDataFrame([position(0, 1, INSIDE), position(1, 2, INSIDE), position(2, 2, FAR), position(3, 3, FAR)], POSITION)
    from tidemark.sources.zones import region_box

    closed = E.close_stale(positions, episodes, as_of, region_box("restricted")).where("mmsi = 2").collect()
    assert sorted(r.tsOut for r in closed) == [T0, as_of]
    assert E.close_stale(positions, episodes, as_of, region_box("restricted")).where("tsOut = timestamp_ntz'2024-01-07'").count() == 1


def test_monitor_cycles_equal_one_pass(spark, restricted):
    rnd = random.Random(4)
    rows = [position(i, rnd.randrange(3), rnd.choice([INSIDE, OUTSIDE, FAR]), i, rnd.randrange(9)) for i in range(80)]
    df = spark.createDataFrame(rows, POSITION)
    at = T0 + timedelta(days=1)
    empty = spark.createDataFrame([], EPISODE)
    whole = W.monitor_zone(df, empty, restricted, at)
    first = W.monitor_zone(df.where("event_id < 40"), empty, restricted, at)
    second = W.monitor_zone(df, spark.createDataFrame(first.collect(), EPISODE), restricted, at)
    again = W.monitor_zone(df, spark.createDataFrame(second.collect(), EPISODE), restricted, at)
    assert rows_of(second) == rows_of(whole) == rows_of(again)


def test_upsert_and_snapshots(spark, tmp_path):
    target = spark.createDataFrame([episode(1, T0), episode(2, T0)], EPISODE)
    changes = spark.createDataFrame([episode(2, T0, out=T0 + timedelta(hours=1)), episode(3, T0)], EPISODE)
    got = io.upsert_episodes(target, changes)
    assert sorted((r.mmsi, r.tsOut is None) for r in got.collect()) == [(1, True), (2, False), (3, True)]
    store = SnapshotStore(spark, f"file://{tmp_path}/s", EPISODE)
    assert store.version() is None and store.read().count() == 0
    store.write(target, 0)
    store.write(got, 1)
    store.write(got, 1)
    assert store.version() == 1 and store.read().count() == 3 and store.previous(1).count() == 2


def test_proximity_equals_all_pairs(spark):
    rnd = random.Random(3)
    places = [(rnd.choice([179.99, -179.99, 10.0]) + rnd.uniform(-0.02, 0.02), rnd.choice([0.0, 60.0, -75.0]) + rnd.uniform(-0.02, 0.02)) for _ in range(150)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(999, None, 1.0)], "mmsi long, longitude double, latitude double")
    got = {(r.mmsi, r.other) for r in proximity_pairs(df).collect()}
    import math

    def distance(a, b):
        f = math.radians
        x = math.sin(f(b[1] - a[1]) / 2) ** 2 + math.cos(f(a[1])) * math.cos(f(b[1])) * math.sin(f(b[0] - a[0]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(x)) / 1852

    assert got == {(i, j) for i, a in enumerate(places) for j, b in enumerate(places) if i != j and distance(a, b) < 1}


def test_proximity_plan_has_no_product(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0)], "mmsi long, longitude double, latitude double")
    plan = proximity_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_fired_anchors_equal_greedy(spark):
    rnd = random.Random(7)
    edges = {(g * 100 + a, g * 100 + b) for g in range(60) for a in range(6) for b in range(6) if a != b and rnd.random() < 0.3}
    order = {v: (T0 + timedelta(minutes=rnd.randrange(20)), v) for v in {x for e in edges for x in e}}
    partners = {a: {b for x, b in edges if x == a} for a, _ in edges}
    flagged, fired = set(), set()
    for a in sorted(partners, key=order.get):
        if a not in flagged:
            fired.add(a)
            flagged |= {a} | partners[a]
    pairs = spark.createDataFrame([(a, b, order[a]) for a, b in edges], "a long, b long, oa struct<t:timestamp_ntz,m:long>")
    assert {r.a for r in S.fired_anchors(pairs).collect()} == fired


def view(spark, hulls):
    """Slow vessels in a row, 30 m apart."""
    as_of = T0 + timedelta(days=2)
    episodes = [episode(m, T0 + timedelta(minutes=k), longitude=104.7 + lon) for m, (k, lon, _) in hulls.items()]
    static = [("A", m, kind, "x", f"n{m}", "c", m, 50, 50, 15, 15, "d") for m, (_, _, kind) in hulls.items()]
    from tidemark.sources.schemas import STATIC

    return S.restrict_view(spark.createDataFrame(episodes, EPISODE), spark.createDataFrame(static, STATIC), as_of), as_of


@pytest.mark.parametrize("order,flagged", [((0, 1, 2), {1, 2}), ((1, 0, 2), {1, 2, 3})])
def test_sts_chain_depends_on_order(spark, order, flagged):
    near = 7e-4  # about 78 m, within 30 + 50 m
    v, as_of = view(spark, {1: (order[0], 0.0, 80), 2: (order[1], near, 80), 3: (order[2], 2 * near, 70)})
    assert {r.mmsi for r in S.sts_flagged(v).collect()} == flagged
    found = S.detect_sts(v, as_of).collect()
    assert [r.mmsi for r in found] == ["|".join(map(str, sorted(flagged)))]


def test_sts_without_static_or_time(spark):
    v, as_of = view(spark, {1: (0, 0.0, 80), 2: (1, 1e-4, 70)})
    assert S.detect_sts(v, as_of).count() == 1
    young = v.withColumn("tsDetected", F.when(F.col("mmsi") == 2, F.lit(as_of - timedelta(minutes=50)).cast("timestamp_ntz")).otherwise(F.col("tsDetected")))
    assert S.detect_sts(young, as_of).count() == 0 and S.sts_flagged(young).count() == 2
    assert S.sts_flagged(v.withColumn("beam_m", F.lit(None).cast("long"))).count() == 0


def test_consecutive_repeats(spark):
    rows = [(0, 1, 1), (1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 1), (5, 1, 1)]
    df = spark.createDataFrame(rows, "event_id long, ts long, mmsi long")
    assert [r.event_id for r in W.drop_consecutive_repeats(df).orderBy("event_id").collect()] == [0, 2, 3]


def test_warehouse_reads(spark):
    """A JDBC source in this JVM: the database that Spark itself brings."""
    options = {"url": "jdbc:derby:memory:tidemark;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id AS mmsi", "id * 0.5D AS sog").write.format("jdbc").options(**options, dbtable="reports").mode("overwrite").save()
    query = 'SELECT "mmsi", "sog" FROM reports WHERE "sog" >= 10'
    whole = io.read_warehouse(spark, options, query)
    parts = io.read_warehouse(spark, options, query, {"partitionColumn": "mmsi", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"})
    assert parts.rdd.getNumPartitions() == 4
    assert sorted(whole.collect()) == sorted(parts.collect()) == [(i, i * 0.5) for i in range(20, 100)]


def test_geojson_and_json(spark):
    import json

    df = spark.createDataFrame([position(1, 5, (1.0, 2.0)), position(0, 5, (3.0, 4.0))], POSITION)
    text = io.to_geojson(W.track_linestring(df), "p").first().value
    assert json.loads(text) == {"payload": "p", "mmsi": "5", "geoSourceData": {"type": "geojson", "data": {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[3.0, 4.0], [1.0, 2.0]]}}}}
    assert json.loads(io.to_json_records(df.select("mmsi"), "q").first().value) == {"mmsi": 5, "payload": "q"}
    nothing = df.select("mmsi", F.lit(None).cast("double").alias("cog"))
    assert json.loads(io.to_json_records(nothing, "q").first().value) == {"mmsi": 5, "cog": None, "payload": "q"}
