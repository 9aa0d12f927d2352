"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (its target share of the total over its own size); each document draws its
number of copies from a Poisson distribution with that mean, by inverting the distribution at a number hashed from the
seed and the document's id, so that a draw never depends on the partitioning. Copies are dealt by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_apart, stored, table, without

#: Largest mean inverted at once; larger means are sums of equal independent parts.
PART = 500.0
#: Sources whose rates are sent to all tasks (about 10 kB each at the largest mean, 0.5 kB at usual ones); of more, only large ones' are.
MOST_SENT = 2_000


def hash_unit(*parts: Column) -> Column:
    """52 bits of an md5 as a number in [0, 1)."""
    return hash_long(*parts).cast("double") / F.lit(float(1 << 52))


def hash_long(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float], total: int | None, source: str) -> DataFrame:
    """source, rate, parts and the cumulative distribution of one part, for each source in docs.

    weights: shares of listed sources; sources not listed share what is left equally. total: rows wanted, as many as
    there are if None.
    """
    sizes = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("size"))
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    share = F.try_element_at(given, F.col("mix_source")) if weights else F.lit(None).cast("double")
    sizes = stored(sizes.withColumn("share", share.cast("double")), "mix-sizes")
    whole = sizes.agg(F.sum("size").alias("n"), F.count(F.when(F.col("share").isNull(), 1)).alias("unlisted"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("listed")).first()
    rest = max(0.0, 1.0 - whole.listed) / max(1, whole.unlisted)
    rate = F.coalesce("share", F.lit(rest)) * F.lit(float(total if total is not None else whole.n or 0)) / F.col("size")
    rates = sizes.select("mix_source", "size", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(30.0)).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"), F.concat(a["cdf"], F.array(a["c"] + a["p"] * mean / k)).alias("cdf")),
    )
    return rates.withColumn("cdf", steps["cdf"])


def mix_sources(docs: DataFrame, weights: dict[str, float], total: int | None = None, seed: int = 0, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs replicated to target weights and shuffled: all columns, then copy_no (from 1), n_copies, shuffle_key.

    Null sources are a source of their own, not listed in weights. Null and empty texts count like others. Repeated
    rows draw the same number, as the draw is the id's. Columns with the three names are replaced. An empty table
    gives no rows; a source of weight 0 disappears.
    """
    docs = without(docs, ["copy_no", "n_copies", "shuffle_key"])
    rates = stored(source_rates(docs, weights, total, source), "mix-rates")
    rates = rates.toDF(*[f"__mix_{c}" for c in rates.columns])
    if rates.count() <= MOST_SENT:
        joined = docs.join(F.broadcast(rates), F.col(f"`{source}`").eqNullSafe(F.col("__mix_mix_source")))
    else:
        # large sources are joined apart; a null source is a name of its own
        name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("__source")
        named = rates.select("*", name("__mix_mix_source"))
        joined = join_apart(docs.select("*", name(f"`{source}`")), named, ["__source"], rates.agg(F.sum("__mix_size")).first()[0], "__mix_size")
    ident = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    draw = lambda j: F.size(F.filter("__mix_cdf", lambda c: c <= hash_unit(F.lit(f"draw{seed}"), ident, j.cast("string"))))
    count = F.aggregate(F.sequence(F.lit(1), F.col("__mix_parts")), F.lit(0), lambda a, j: a + draw(j))
    copies = joined.withColumn("n_copies", count).where(F.col("n_copies") > 0)
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", hash_long(F.lit(f"deal{seed}"), ident, F.col("copy_no").cast("string")))
    out = copies.select(*[F.col(f"`{c}`") for c in docs.columns], "copy_no", "n_copies", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: Production weights of the query: shares of these sources; the others share the rest equally.
WEIGHTS = {"src0": 0.05, "src1": 0.2, "src2": 0.1}
SEED = 7


def op1_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, seed=SEED)


OP1_SQL = f"""
WITH sizes AS (
  SELECT source, count(*) AS size,
         CASE source {' '.join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items())} END AS share
  FROM documents GROUP BY source
), whole AS (
  SELECT CAST(sum(size) AS DOUBLE) AS n, count(*) FILTER (WHERE share IS NULL) AS unlisted, coalesce(sum(share), 0e0) AS listed FROM sizes
), rates AS (
  SELECT source, coalesce(share, greatest(0e0, 1e0 - listed) / greatest(1, unlisted)) * n / size AS rate FROM sizes, whole
), steps AS (
  SELECT source, rate, k, exp(-rate) * power(rate, k) / gamma(CAST(k + 1 AS DOUBLE)) AS p FROM rates, range(0, 120) t(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), drawn AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('draw{SEED}:' || doc_id || ':1'), 1, 13) AS BIGINT) / 4503599627370496e0 AS u FROM documents
), counts AS (
  SELECT d.doc_id, count(*) AS n FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id
)
SELECT d.*, CAST(t.k AS INTEGER) AS copy_no, CAST(c.n AS INTEGER) AS n_copies,
       CAST('0x' || substr(md5('deal{SEED}:' || d.doc_id || ':' || t.k), 1, 13) AS BIGINT) AS shuffle_key
FROM documents d JOIN counts c USING (doc_id), range(1, 200) t(k) WHERE t.k <= c.n
"""
