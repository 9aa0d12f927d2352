"""Reading and writing the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def _read(spark: SparkSession, source: str | dict, schema: T.StructType) -> DataFrame:
    """source: a Parquet path, or the options of a JDBC source (with dbtable or query)."""
    if isinstance(source, dict):
        return schemas.conform(spark.read.format("jdbc").options(**source).load(), schema)
    return spark.read.schema(schema).parquet(source)


def read_positions(spark: SparkSession, source: str | dict, feed: str | None = None) -> DataFrame:
    """Position reports with NaN numbers as null; feed names a source that has no feed column of its own."""
    df = _read(spark, source, schemas.POSITION)
    numbers = [f.name for f in schemas.POSITION if f.dataType == T.DoubleType()]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    return df.withColumn("feed", F.coalesce("feed", F.lit(feed))) if feed else df


def read_static(spark: SparkSession, source: str | dict) -> DataFrame:
    return _read(spark, source, schemas.STATIC)


def read_episodes(spark: SparkSession, source: str | dict) -> DataFrame:
    return _read(spark, source, schemas.EPISODE)


def read_warehouse(spark: SparkSession, options: dict, query: str, partition: dict | None = None) -> DataFrame:
    """A remote query; partition: partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    if partition:
        return spark.read.format("jdbc").options(**options, dbtable=f"({query}) q", **partition).load()
    return spark.read.format("jdbc").options(**options, query=query).load()


def read_history(spark: SparkSession, path: str, mmsi: int | None = None) -> DataFrame:
    """Vessel histories in time order; one vessel's by partition pruning."""
    df = spark.read.parquet(path)
    if mmsi is not None:
        df = df.where((F.col("mmsi_bucket") == F.pmod(F.lit(mmsi), F.lit(BUCKETS))) & (F.col("mmsi") == mmsi)) if "mmsi_bucket" in df.columns else df.where(F.col("mmsi") == mmsi)
    return df.drop("mmsi_bucket").orderBy("mmsi", "ts")


#: Directories of a written history; a vessel's rows lie in one of them, in time order.
BUCKETS = 64


def write_history(df: DataFrame, path: str, mode: str = "error") -> None:
    with_bucket = df.withColumn("mmsi_bucket", F.pmod("mmsi", F.lit(BUCKETS)).cast("int"))
    with_bucket.repartition("mmsi_bucket").sortWithinPartitions("mmsi_bucket", "mmsi", "ts").write.mode(mode).partitionBy("mmsi_bucket").parquet(path)


def stream_positions(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Positions that arrive as Parquet files; ts as a timestamp, so that it can carry a watermark."""
    reader = spark.readStream.schema(schemas.POSITION)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def upsert_episodes(target: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("mmsi", "zone", "tsDetected")) -> DataFrame:
    """target with the rows of changes replacing those of equal keys and new ones added; the columns of target."""
    new = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns], F.lit(True).alias("__new"))
    same = [target[k].eqNullSafe(new[f"__{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    pick = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(target[c]) if c in changes.columns else target[c]
    return target.join(new, condition, "full_outer").select(*[pick(c).alias(c) for c in target.columns])


def to_json_records(df: DataFrame, payload: str, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text (value) for each row, nulls as null, with a payload tag at its end; keep: columns to go along beside it."""
    return df.select(*keep, F.to_json(F.struct(*(columns or df.columns), F.lit(payload).alias("payload")), {"ignoreNullFields": "false"}).alias("value"))


def to_geojson(tracks: DataFrame, payload: str, points: str = "points", keep: tuple[str, ...] = ()) -> DataFrame:
    """mmsi and value: the message that brings a vessel's track as a map source; points is array<struct<lon,lat>>."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), line.alias("geometry"))
    source = F.struct(F.lit("geojson").alias("type"), feature.alias("data"))
    message = F.struct(F.lit(payload).alias("payload"), F.col("mmsi").cast("string").alias("mmsi"), source.alias("geoSourceData"))
    return tracks.select("mmsi", *keep, F.to_json(message).alias("value"))
