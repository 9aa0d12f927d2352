"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x to the cells floor((a_i . x + b_i) / width) of a few Gaussian projections a_i. A query visits
a table's buckets in the order of their estimated success, the probability that a neighbour at an assumed distance falls
into the bucket given where the query lies in its own cells, until the visited probabilities reach a target. Buckets are
dealt to parts of bounded size. A query goes once to each part that holds some of its buckets, with their list, so that its
vector isn't repeated for each bucket and each part gives its k best once; parts made large by a full bucket are split into
blocks that each get the part's queries. In a block distances to the rows of visited buckets are computed by matrix
products, the best are measured exactly, and tables' candidates are merged. What a task holds is bounded in bytes: one
block, and batches of BATCH bytes.

The first round assumes the distance met in a sample. Then each query's own k-th distance tells how likely its probes
would have met a neighbour that far away; where that is too little, or fewer than k rows were found, a second round asks
again: with probes for its own distance, or, if those would be more than there are blocks of rows or none is known, with
every block of rows. So a query always gets all that there is up to k, however its neighbourhood is scaled.

Equal vectors are folded to one with its smallest ids before hashing, so one vector may make up any share of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Rows of the sample from which distances are learned; only for choosing parameters, all rows are indexed.
SAMPLE = 2_000
TABLES = 4
#: Probability that one table's visited buckets hold a given neighbour. With TABLES: 1 - (1 - 0.6)^4 = 0.97.
SUCCESS = 0.6
#: Estimated success over all tables at a query's own k-th distance below which it is asked again.
ENOUGH = 0.9
#: Cell width in standard deviations of a projection.
WIDTH = 1.0
#: Vectors compared at once, and the unit in which a full search is weighed against probes.
BLOCK = 4_096
#: Bytes of a part's vectors as doubles, on average; a task holds at most twice as many rows at once.
PART = 32 << 20
#: Bytes of probes given out at once, and cells of a matrix of distances.
BATCH, MATRIX = 4 << 20, 1 << 20
#: Cells looked at on either side in each projection, and buckets looked at for one query and table. Where they keep the
#: success below SUCCESS, the query meets every block instead.
REACH, MOST_CELLS = 3, 50_000


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tables:
    """Projections of all tables and the learned distance."""

    def __init__(self, dim: int, count: int, scale: float, near: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.hashes = int(np.clip(round((math.log2(max(count, 2)) - 8) / 2), 4, 12))
        self.near = max(near, 1e-12)
        self.width = WIDTH * max(scale, 1e-12)
        self.a = rng.standard_normal((TABLES, self.hashes, dim))
        self.b = rng.uniform(0, self.width, (TABLES, self.hashes))
        self.mix = rng.integers(1, 1 << 62, (self.hashes,), dtype=np.int64) | 1

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t].T + self.b[t]) / self.width

    def key(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def _chances(self, place: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
        """Offsets from the home cell, and by projection the probability of each for a neighbour at distance near."""
        edges = np.arange(-REACH, REACH + 2)
        below = _normal_cdf((np.floor(place)[:, None] + edges[None] - place[:, None]) * self.width / near)
        return edges[:-1], np.diff(below, axis=1)

    @staticmethod
    def _likely(offsets: np.ndarray, chance: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, bool, bool]:
        """Offsets of the cells whose success is at least so much, their success, and whether MOST_CELLS cut or least left out any."""
        ahead = np.append(np.cumprod(chance.max(axis=1)[::-1])[::-1][1:], 1.0)
        cells, success, cut, left = np.zeros((1, 0), int), np.ones(1), False, False
        for i in range(len(chance)):
            grown = success[:, None] * chance[i][None]
            kept = ~(grown * ahead[i] < least)
            left = left or bool((grown[~kept] > 0).any())
            row, col = np.nonzero(kept)
            success = grown[row, col]
            if len(success) > MOST_CELLS:
                best = np.argpartition(-success, MOST_CELLS)[:MOST_CELLS]
                row, col, success, cut = row[best], col[best], success[best], True
            cells = np.hstack([cells[row], offsets[col][:, None]])
        return cells, success, cut, left

    def probes(self, place: np.ndarray, near: float) -> tuple[np.ndarray, float]:
        """Cells (rows) to visit for one query in one table, in estimated success order, and their success in all."""
        offsets, chance = self._chances(place, near)
        # unlikely cells are left out as long as the others are enough
        least = float(chance.max(axis=1).prod()) / 16
        while True:
            cells, success, cut, left = self._likely(offsets, chance, least)
            if not left or success.sum() >= SUCCESS:
                break
            least = 0.0 if cut else least / (2 if success.sum() > 0.9 * SUCCESS else 8)
        order = np.argsort(-success, kind="stable")
        reached = np.cumsum(success[order])
        enough = min(len(order), int(np.searchsorted(reached, SUCCESS)) + 1)
        return np.floor(place) + cells[order[:enough]], float(reached[enough - 1])

    def success(self, place: np.ndarray, cells: np.ndarray, near: float) -> float:
        """Probability that a neighbour at distance near lies in one of the cells."""
        offsets, chance = self._chances(place, near)
        at = (cells - np.floor(place)).astype(int) + REACH
        return float(chance[np.arange(len(place))[None], at].prod(axis=1).sum())


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(z)


def _learned(classes: DataFrame, count: int, dim: int, k: int) -> Tables:
    """Scale of projections and distance of the k-th neighbour, from a bounded sample."""
    rows = classes.where(F.pmod(F.xxhash64(F.lit("ann"), F.col("cid")), F.lit(max(1, count // SAMPLE))) == 0).select("v").limit(2 * SAMPLE).collect()
    x = np.array([r.v for r in rows], dtype=float).reshape(-1, dim)
    if len(x) < 3:
        return Tables(dim, count, 1.0, 1.0)
    # medians, as a few far vectors would make cells so wide that all others share one
    scale = float(np.sqrt(np.median(((x - np.median(x, axis=0)) ** 2).sum(axis=1))))
    norm = (x * x).sum(axis=1)
    some = x[:500]
    d2 = np.maximum(0, (some * some).sum(axis=1)[:, None] + norm[None] - 2 * some @ x.T)
    d2.sort(axis=1)
    return Tables(dim, count, scale, float(np.sqrt(np.median(d2[:, min(k, len(x) - 1)]))))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each bucket in the upper half, and in the lower one its number there; few buckets share a number, as if they were one."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64(32)
    return ((mixed >> low) % np.uint64(parts) << low | (mixed ^ mixed >> low) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _halves(dealt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (dealt >> 32).astype(np.int32), dealt.astype(np.uint32).view(np.int32)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def _probed(tables: Tables, parts: int, x: np.ndarray, near: np.ndarray, cid: pa.Array, v: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each query, table and part with the buckets to visit there, in batches of about BATCH bytes."""
    width = v.nbytes // max(1, len(v))
    for t in range(TABLES):
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        places = tables.places(x, t)
        for i in range(len(x)):
            at, keys = _halves(np.unique(_dealt(tables.key(tables.probes(places[i], near[i])[0]), parts)))
            waiting.append((i, at, keys))
            held += keys.nbytes + (width + 32) * (1 + np.count_nonzero(np.diff(at)))
            if held < BATCH and i + 1 < len(x):
                continue
            at, keys = (np.concatenate([w[c] for w in waiting]) for c in (1, 2))
            row = np.repeat([w[0] for w in waiting], [len(w[1]) for w in waiting])
            starts = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])))[0]
            mine = pa.array(row[starts])
            yield pa.record_batch([pa.array(np.full(len(starts), t, np.int32)), pa.array(at[starts]), _lists(keys, starts), cid.take(mine), v.take(mine)], names=["t", "part", "keys", "cid", "v"])
            waiting, held = [], 0


def _measured(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    step = max(1, BATCH // (8 * q.shape[1]))
    cuts = range(0, len(row), step)
    return np.concatenate([np.zeros(0), *(np.sqrt(((q[row[i : i + step]] - x[col[i : i + step]].astype(float)) ** 2).sum(axis=1)) for i in cuts)])


class Block:
    """Rows of a block by bucket."""

    def __init__(self, keys: list[np.ndarray], ids: list[np.ndarray], xs: list[np.ndarray]):
        bucket = np.concatenate(keys)
        order = np.argsort(bucket, kind="stable")
        self.ids, self.x = np.concatenate(ids)[order], np.concatenate(xs)
        for held in (keys, ids, xs):
            held.clear()
        self.x = self.x[order]
        self.buckets, starts = np.unique(bucket[order], return_index=True)
        self.ends = np.append(starts, len(order))
        step = max(1, BATCH // (8 * self.x.shape[1]))
        self.norm = np.concatenate([(self.x[i : i + step].astype(float) ** 2).sum(axis=1) for i in range(0, len(order), step)])

    def nearest(self, queries: np.ndarray, q: np.ndarray, keys: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows, measured exactly, of the buckets that each query visits; keys and row: visited buckets and whose they are."""
        at = np.minimum(np.searchsorted(self.buckets, keys), len(self.buckets) - 1)
        met = self.buckets[at] == keys
        at, row = at[met], row[met]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        cuts = [0, *(np.nonzero(at[1:] != at[:-1])[0] + 1).tolist(), len(at)] if len(at) else []
        own = (q * q).sum(axis=1)
        # what the product's rounding may hide is kept, so that the exact measure decides
        slack = 4e-15 * q.shape[1] * (own + self.norm.max())
        best = np.full((len(q), k), np.inf)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            for c in range(self.ends[at[a]], self.ends[at[a] + 1], BLOCK):
                e = min(c + BLOCK, self.ends[at[a] + 1])
                x, norm = self.x[c:e].astype(float), self.norm[c:e]
                step = max(1, MATRIX // (e - c))
                for f in range(a, b, step):
                    mine = row[f : min(f + step, b)]
                    d2 = own[mine, None] + norm[None] - 2 * (q[mine] @ x.T)
                    hit = np.nonzero(~(d2.min(axis=1) > best[mine].max(axis=1) + slack[mine]))[0]
                    if not len(hit):
                        continue
                    mine, d2 = mine[hit], d2[hit]
                    least = np.partition(d2, k - 1, axis=1)[:, :k] if e - c > k else d2
                    best[mine] = np.partition(np.hstack([best[mine], least]), k - 1, axis=1)[:, :k]
                    one, col = np.nonzero(~(d2 > (best[mine].max(axis=1) + slack[mine])[:, None]))
                    found.append((mine[one], col + c))
                    size += len(one)
                    if size > MATRIX:
                        found, size = [self._first(q, found, k)[:2]], 0
        one, col, exact = self._first(q, found, k)
        return queries[one], self.ids[col], exact

    def _first(self, q: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, col = (np.concatenate([np.zeros(0, int), *(f[i] for f in found)]) for i in range(2))
        exact = _measured(q, self.x, one, col)
        order = np.lexsort((self.ids[col], exact, one))
        one, col, exact = one[order], col[order], exact[order]
        kept = np.arange(len(one)) - np.searchsorted(one, one) < k
        return one[kept], col[kept], exact[kept]


def _compared(parts: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sorted by table, part and block, its rows before its queries; a block's rows are held, queries pass by."""
    at, rows, block = None, ([], [], []), None
    for part in parts:
        if not part.num_rows:
            continue
        g = np.stack([part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        cuts = [0, *(np.nonzero((g[1:] != g[:-1]).any(axis=1))[0] + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            cid, keys, v = part.column(4)[a:b].to_numpy(), part.column(5)[a:b], _vectors(part.column(6)[a:b], dim)
            if tuple(g[a, :3]) != at:
                at, rows, block = tuple(g[a, :3]), ([], [], []), None
            if not g[a, 3]:
                for held, x in zip(rows, (keys.flatten().to_numpy(), cid, v), strict=True):
                    held.append(x)
            elif rows[0] or block:
                block = block or Block(*rows)
                visited = np.repeat(np.arange(b - a), keys.value_lengths().to_numpy())
                best = block.nearest(cid, v.astype(float), keys.flatten().to_numpy(), visited, k)
                yield pa.record_batch([pa.array(y) for y in best], names=["qcid", "cid", "d"])


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows by Euclidean distance, ties to smaller ids.

    queries: which rows of vectors are queries. Rows whose vector is null, zero, or holds a null or non-finite
    component take no part, nor do rows with a null id or of another length than the most frequent one. All others
    are indexed. Equal vectors of different ids are neighbours at distance 0. Repeated rows count once; rows of one id
    and different vectors are one neighbour, at the least distance, and ask as one query for each of their vectors; rows
    with the query's id are never its neighbours. Every query gets k ids, or all others if they are fewer; which k is
    approximate. Empty tables give no rows; other columns are not read.
    """
    found = _searched(vectors, queries, k, key, vector)
    return found.select("query_id", "rank", "vec_id", "score")


def _searched(vectors: DataFrame, queries: Column, k: int, key: str, vector: str) -> DataFrame:
    """The result of nearest_neighbours, and asked: the round that a query was answered in (1, 2, or 3 by all blocks)."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0].d if lengths else 1
    good = good.where(F.size("v") == dim).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})
    # as many ids of one vector as a list can hold, with one of the query's own
    first = Window.partitionBy("k1", "k2").orderBy("id")
    few = good.select("k1", "k2", "id").distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    few = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = good.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.first("v").alias("v")).join(few, ["k1", "k2"])
    classes = stored(classes.select("cid", "v", "ids", "k1", "k2"), "ann-classes")
    # a repeated id may be the least one of several vectors
    if not classes.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        classes = stored(classes.withColumn("cid", F.xxhash64("k1", "k2")), "ann-classes")
    asked = stored(good.where("q").select("id", "k1", "k2").distinct().join(classes.select("k1", "k2", "cid"), ["k1", "k2"]).select("id", "cid"), "ann-queries")
    count = classes.count()
    tables = _learned(classes, count, dim, k)
    top = k + 2
    kind = dict(classes.dtypes)["v"]
    schema = f"t int, part int, keys array<int>, cid long, v {kind}"
    columns = ["t", "part", "block", "probe", "cid", "keys", "v"]
    whole = max(1, -(-count // BLOCK))
    # parts are as large as memory allows, unless there would be fewer than three for each core
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(PART // (8 * max(1, dim)), max(BLOCK, TABLES * count // (3 * cores))))
    dealt = max(1, -(-count // most))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _vectors(part.column(1), dim).astype(float)
            for t in range(TABLES):
                at, keys = _halves(_dealt(tables.key(np.floor(tables.places(x, t))), dealt))
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(at), _lists(keys, np.arange(len(x))), part.column(0), part.column(1)], names=["t", "part", "keys", "cid", "v"])

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from _probed(tables, dealt, _vectors(part.column(1), dim).astype(float), part.column(2).to_numpy(), part.column(0), part.column(1))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to ask again, with the distance to assume, or none for those that are to meet every block."""
        for part in parts:
            x, reached = _vectors(part.column(1), dim).astype(float), part.column(2).to_numpy(zero_copy_only=False)
            again, near = [], []
            for i in range(len(x)):
                own = max(float(reached[i]), 1e-12)
                places = [tables.places(x[i : i + 1], t)[0] for t in range(TABLES)] if np.isfinite(own) else []
                missed = 1.0
                for p in places:
                    missed *= 1 - tables.success(p, tables.probes(p, tables.near)[0], own)
                    if enough := 1 - missed >= ENOUGH:
                        break
                if places and enough:
                    continue
                wider = [tables.probes(p, own) for p in places]
                again.append(i)
                near.append(own if wider and min(w for _, w in wider) >= SUCCESS and sum(len(c) for c, _ in wider) <= whole else None)
            at = pa.array(again, pa.int64())
            yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), pa.array(near, pa.float64())], names=["cid", "v", "near"])

    def compared(rows: DataFrame, probes: DataFrame) -> DataFrame:
        """qcid, cid, d of the nearest in all blocks that a query meets."""
        met = rows.withColumn("probe", F.lit(False)).select(columns).union(probes.withColumn("probe", F.lit(True)).select(columns))
        met = met.repartition(2 * TABLES * dealt, "t", "part", "block").sortWithinPartitions("t", "part", "block", "probe")
        return met.mapInArrow(lambda parts: _compared(parts, dim, top), "qcid long, cid long, d double")

    def nearest(pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("qcid").orderBy("d", "cid")
        pairs = pairs.groupBy("qcid", "cid").agg(F.min("d").alias("d"))
        return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top).drop("rn")

    flat = classes.select("cid", "v")
    rows = flat.mapInArrow(place, schema)
    # a part of a full bucket is split
    large = stored(rows.groupBy("t", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * most)).cast("int").alias("blocks")).where("blocks > 1"), "ann-parts")
    rows = rows.join(large, ["t", "part"], "left").withColumn("block", F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int"))

    def hashed(seeking: DataFrame) -> DataFrame:
        probes = seeking.repartition(3 * cores, "cid").mapInArrow(probe, schema).join(large, ["t", "part"], "left")
        return compared(rows, probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))))

    seeking = stored(flat.join(asked.select("cid").distinct(), "cid"), "ann-seeking")
    found = stored(nearest(hashed(seeking.withColumn("near", F.lit(tables.near)))), "ann-found")
    # the distance of the k-th row besides the query's own; infinite if fewer were found
    order = Window.partitionBy("qcid").orderBy("d", "cid")
    upto = found.join(classes.select("cid", F.size("ids").alias("n")), "cid").withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reached = upto.where(F.col("upto") > k).groupBy(F.col("qcid").alias("cid")).agg(F.min("d").alias("reached"))
    judged = seeking.join(reached, "cid", "left").select("cid", "v", F.coalesce("reached", F.lit(float("inf"))).alias("reached"))
    again = stored(judged.repartition(3 * cores, "cid").mapInArrow(judge, f"cid long, v {kind}, near double"), "ann-again")
    if not again.isEmpty():
        more = hashed(again.where("near IS NOT NULL"))
        every = again.where("near IS NULL").select("cid", "v")
        if not every.isEmpty():
            blocked = lambda df, at: df.select(F.lit(TABLES).alias("t"), at.alias("part"), F.lit(0).alias("block"), F.array(F.lit(0)).alias("keys"), "cid", "v")
            numbers = F.sequence(F.lit(0), F.lit(dealt - 1))
            more = more.union(compared(blocked(flat, F.pmod(F.xxhash64("cid"), F.lit(dealt)).cast("int")), blocked(every, F.explode(numbers))))
        found = stored(nearest(found.union(stored(more, "ann-more"))), "ann-found")
    rounds = again.select("cid", F.when(F.col("near").isNull(), 3).otherwise(2).alias("asked"))
    found = found.join(classes.select("cid", "ids"), "cid").select("qcid", "d", F.explode("ids").alias("id")).groupBy("qcid", "id").agg(F.min("d").alias("d"))
    order = Window.partitionBy("qcid").orderBy("d", "id")
    found = found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
    lists = found.groupBy(F.col("qcid").alias("cid")).agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("near"))
    lists = lists.join(again.select("cid", F.when(F.col("near").isNull(), 3).otherwise(2).alias("asked")), "cid", "left")
    own = asked.join(lists, "cid").select(F.col("id").alias("query_id"), "asked", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    out = own.select("query_id", "asked", F.posexplode("near").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"), F.coalesce("asked", F.lit(1)).alias("asked"))


def op7_nearest_neighbours(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
