"""Hard negatives for embedding training, by segment summary filtering.

Every vector is stored with the mean and deviation of its segments: of the whole, of its halves, quarters and so on. An
inner product over a segment of n components is n times the product of the means, plus or minus at most the product of
the deviations (root sums of squares about the means), so summaries bound a score from both sides. Anchors meet rows in
blocks: in each, bounds by whole vectors rule out most rows, those by halves some of the rest, and so on; what is left
is scored exactly. A block returns the best it has, and blocks' lists are merged.

Equal vectors of one label are folded to one with its smallest ids, so one vector may make up any share of the rows,
and rows of a label are dealt to blocks, so one label may too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Rows of a block.
BLOCK = 8_192
#: Components of the smallest segments.
LEAST_SEGMENT = 8


class Segments:
    """Segments of vectors of one length, by levels: 1, 2, 4, ... segments."""

    def __init__(self, dim: int):
        cuts, self.levels = [], []
        parts = 1
        while parts == 1 or dim // parts >= LEAST_SEGMENT:
            bounds = np.linspace(0, dim, parts + 1).astype(int)
            self.levels.append(slice(len(cuts), len(cuts) + parts))
            cuts += list(zip(bounds, bounds[1:], strict=False))
            parts *= 2
        self.cuts, self.size = cuts, np.array([b - a for a, b in cuts], dtype=float)

    def summaries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of all segments (columns) of vectors (rows)."""
        mean = np.stack([x[:, a:b].mean(axis=1) for a, b in self.cuts], axis=1)
        dev = np.stack([np.sqrt(((x[:, a:b] - mean[:, [i]]) ** 2).sum(axis=1)) for i, (a, b) in enumerate(self.cuts)], axis=1)
        return mean, dev

    def bounds(self, level: slice, mean: np.ndarray, dev: np.ndarray, rows: np.ndarray, q: int, qmean: np.ndarray, qdev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score that each of the rows can have with query q."""
        middle = mean[rows, level] @ (self.size[level] * qmean[q, level])
        spread = dev[rows, level] @ qdev[q, level]
        # room for rounding
        spread = spread + 1e-9 * (1 + np.abs(middle) + spread)
        return middle - spread, middle + spread


class Block:
    """Rows of a block: a class's number, smallest id, label, vector and summaries."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.cid, self.least, self.label, self.x, self.mean, self.dev = (np.concatenate(c) for c in zip(*parts, strict=True))


def _best(score: np.ndarray, least: np.ndarray, top: int) -> np.ndarray:
    """The first `top` by highest score, ties by smallest id."""
    return np.lexsort((least, -score))[:top]


def positives_in(block: Block, segments: Segments, q: int, qs: Block, targets: np.ndarray | None, top: int, low: int, high: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(0, rows, scores): the highest scores of the block with query q, whose label all its rows have."""
    rows = np.arange(len(block.cid))
    for level in segments.levels:
        if len(rows) <= top:
            break
        least, most = segments.bounds(level, block.mean, block.dev, rows, q, qs.mean, qs.dev)
        rows = rows[most >= np.partition(least, -top)[-top]]
    score = block.x[rows] @ qs.x[q]
    best = _best(score, block.least[rows], top)
    return [(0.0, rows[best], score[best])]


def negatives_in(block: Block, segments: Segments, q: int, qs: Block, targets: np.ndarray | None, top: int, low: int, high: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(target, rows, scores) for each target score: the highest scores from low to high percent of it, of rows of other labels."""
    rows = np.nonzero(block.label != qs.label[q])[0]
    for level in segments.levels:
        if len(rows) <= top:
            break
        least, most = segments.bounds(level, block.mean, block.dev, rows, q, qs.mean, qs.dev)
        keep = np.zeros(len(rows), dtype=bool)
        for t in targets:
            may = (100 * most >= low * t) & (100 * least <= high * t)
            sure = least[may & (100 * least >= low * t) & (100 * most <= high * t)]
            if len(sure) >= top:
                may &= most >= np.partition(sure, -top)[-top]
            keep |= may
        rows = rows[keep]
    score = block.x[rows] @ qs.x[q]
    out = []
    for t in targets:
        own = np.nonzero((low * t <= 100 * score) & (100 * score <= high * t))[0]
        own = own[_best(score[own], block.least[rows[own]], top)]
        out.append((float(t), rows[own], score[own]))
    return out


_ROW = "cid long, least long, label long, x array<double>, mean array<double>, dev array<double>"
_COLUMNS = ["block", "asks", "cid", "least", "label", "x", "mean", "dev", "targets"]


def _met(rows: DataFrame, queries: DataFrame, dim: int, best: Callable, top: int, low: int, high: int) -> DataFrame:
    """q, target, cid and score of the best rows of all blocks that a query meets; both tables have block and _ROW, queries targets."""

    def matrix(column: pa.Array, a: int, b: int, width: int) -> np.ndarray:
        return column.slice(a, b - a).flatten().to_numpy().reshape(-1, width)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block, its rows before its queries; a block's rows are held, queries pass by."""
        segments, at, held, block = Segments(dim), None, [], None
        width = len(segments.cuts)
        for part in parts:
            if not part.num_rows:
                continue
            key, asks = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1] or asks[i] != asks[i - 1]), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key[a] != at:
                    at, held, block = key[a], [], None
                numbers = [part.column(c).slice(a, b - a).to_numpy() for c in (2, 3, 4)]
                own = (*numbers, matrix(part.column(5), a, b, dim), matrix(part.column(6), a, b, width), matrix(part.column(7), a, b, width))
                if not asks[a]:
                    held.append(own)
                elif held:
                    block = block or Block(held)
                    qs, targets = Block([own]), part.column(8).slice(a, b - a).to_pylist()
                    found = [(int(qs.cid[q]), t, block.cid[rows], score) for q in range(b - a) for t, rows, score in best(block, segments, q, qs, targets[q], top, low, high)]
                    size = [len(x[2]) for x in found]
                    if sum(size):
                        lists = [np.repeat([x[0] for x in found], size), np.repeat([x[1] for x in found], size), np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])]
                        yield pa.record_batch([pa.array(lists[0], pa.int64()), pa.array(lists[1], pa.float64()), pa.array(lists[2], pa.int64()), pa.array(lists[3], pa.float64())], names=["q", "target", "cid", "score"])

    empty = F.array().cast("array<double>")
    both = rows.withColumns({"asks": F.lit(False), "targets": empty}).select(_COLUMNS).union(queries.withColumn("asks", F.lit(True)).select(_COLUMNS))
    dealt = both.repartition("block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(compare, "q long, target double, cid long, score double")


def _lists(met: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """q, target and best: the first `top` (score, id) by highest score and smallest id, of the rows of all classes met."""
    order = Window.partitionBy("q", "target").orderBy(F.desc("score"), "least")
    met = met.join(classes.select("cid", "least", "ids"), "cid").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    one = met.select("q", "target", "score", F.explode("ids").alias("key")).select("q", "target", F.struct((-F.col("score")).alias("s"), F.col("key").alias("id")).alias("x"))
    return one.groupBy("q", "target").agg(F.slice(F.array_sort(F.collect_list("x")), 1, top).alias("best"))


def _classes(vectors: DataFrame, anchors: Column, scale: float, ids: int, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame, int]:
    """Classes of equal scaled vectors and labels with _ROW and their `ids` smallest ids, anchors (id, cid), and the vectors' length."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    good = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite)
    good = good.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("x"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    lengths = good.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = lengths[0].d if lengths else 1
    # floor gives -0.0 for none and 0.0 for others, which hash apart: adding 0.0 makes them one
    good = good.where(F.size("x") == dim).withColumn("x", F.transform("x", lambda c: c + F.lit(0.0))).withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")})
    same = ["k1", "k2", "label"]
    first = Window.partitionBy(*same).orderBy("id")
    few = good.groupBy(*same, "id").agg(F.max("asks").alias("asks"), F.first("x").alias("x"))
    few = stored(few.withColumn("rn", F.row_number().over(first)).where((F.col("rn") <= ids) | F.col("asks")), "negatives-rows")
    classes = few.where(F.col("rn") <= ids).groupBy(*same).agg(F.min("id").alias("least"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("x").alias("x"))

    def summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(dim)
        for part in parts:
            if part.num_rows:
                mean, dev = segments.summaries(part.column("x").flatten().to_numpy().reshape(-1, dim))
                yield part.append_column("mean", pa.array(list(mean), pa.list_(pa.float64()))).append_column("dev", pa.array(list(dev), pa.list_(pa.float64())))

    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", mean array<double>, dev array<double>"
    classes = stored(classes.mapInArrow(summarise, schema), "negatives-classes")
    asked = stored(few.where("asks").select("id", *same).join(classes.select(*same, "cid"), same).select("id", "cid"), "negatives-anchors")
    return classes, asked, dim


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256,
    key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, exactly.

    anchors: which rows of vectors are anchors. Components become floor(scale * x), and a score is their inner product,
    exact while sums stay below 2^53 / 100. An anchor's positives are the first `positives` other rows of its label by
    highest score, ties by smaller id; its negatives for one of them are the first `negatives` rows of other labels whose
    score is from low to high percent of the positive's. A positive without such rows gives none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do empty vectors and
    those of another length than the most frequent one; zero vectors do take part. Repeated rows count once; an id with
    several labels or vectors is a row for each, and none of them is a positive or negative of that id. Equal vectors
    share scores. Other columns are not read. An empty table gives no rows.
    """
    top_p, top_n = positives + 1, negatives + 1
    classes, asked, dim = _classes(vectors, anchors, scale, max(top_p, top_n), key, vector, label)
    rows = classes.select("cid", "least", "label", "x", "mean", "dev")
    seeking = stored(rows.join(asked.select("cid").distinct(), "cid"), "negatives-seeking").withColumn("targets", F.array().cast("array<double>"))

    # positives: the anchors of a label meet the blocks of that label
    sizes = stored(rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "negatives-labels")
    name = lambda part: F.concat_ws("-", F.col("label"), part).alias("block")
    dealt = rows.join(sizes, "label").select("*", name(F.pmod(F.xxhash64("cid"), F.col("blocks")))).drop("blocks")
    asking = seeking.join(sizes, "label").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", name(F.col("part"))).drop("blocks", "part")
    found = _lists(_met(dealt, asking, dim, positives_in, top_p, low, high), classes, top_p)
    own = asked.join(found.select(F.col("q").alias("cid"), "best"), "cid").select("id", "cid", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, positives)).alias("p", "x"))
    own = stored(own.select("id", "cid", F.col("x.id").alias("positive"), (-F.col("x.s")).alias("target")), "negatives-positives")

    # negatives: the anchors, with their positives' scores, meet all blocks
    blocks = max(1, -(-classes.count() // block))
    wanted = own.groupBy("cid").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("string"))
    asking = seeking.drop("targets").join(wanted, "cid").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("part").cast("string")).drop("part")
    found = _lists(_met(dealt, asking, dim, negatives_in, top_n, low, high), classes, top_n)
    met = own.join(found.select(F.col("q").alias("cid"), "target", "best"), ["cid", "target"])
    out = met.select("id", "positive", "target", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, negatives)).alias("p", "x"))
    whole = lambda c: c.cast("long")
    return out.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), whole(F.col("target")).alias("positive_score"), whole(-F.col("x.s")).alias("negative_score"))


def op13_hard_negatives(spark, sf_dir):
    """Anchors of every hundredth id; every seventh id gets the next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.l = b.l AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER w <= 5"""
