"""SimHash near-duplicates by anchor-point covering.

Fingerprints are cut into blocks whose lengths have perfect cyclic codes (Golay, 23 bits, covering radius 3; Hamming,
15 bits, radius 1); a point's anchor is the tuple of its blocks' nearest codewords, and bits outside the blocks are
left to the comparison. Two fingerprints within t bits of each other meet at the anchor of either if each is sent to
every anchor whose block distances exceed the covering radii by t at most in all: that is the set of anchors that a
point within t bits can have. At an anchor its own points are compared with the visitors, exactly and over all bits.

Copies of a fingerprint are folded before, so a third of all documents may share one; at most 1 + 64 + 64 * 63 / 2
different fingerprints lie within 2 bits of one another's centre, which bounds what one point can be linked with.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, join_apart, join_unique, stored, text_bytes, text_slices
from .components import connected_components
from .setjoin import possible_pairs

#: Fingerprints beyond which a third block is taken, so that anchors stay sparsely visited.
LARGE = 1 << 27


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = list(map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)))
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65_536):
        counts += np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


class PerfectCode:
    """A perfect cyclic code: cosets by syndrome, with all their patterns up to the covering radius plus `more`."""

    def __init__(self, length: int, generator: int, radius: int, more: int):
        self.length, self.degree = length, generator.bit_length() - 1
        shifted = [1]
        for _ in range(length - 1):
            x = shifted[-1] << 1
            shifted.append(x ^ generator if x >> self.degree & 1 else x)
        self.half = length // 2
        self.low, self.high = (self._sums(shifted[a:b]) for a, b in ((0, self.half), (self.half, length)))
        found: list[list[tuple[int, int]]] = [[] for _ in range(1 << self.degree)]
        for weight in range(radius + more + 1):
            for bits in combinations(range(length), weight):
                pattern = syndrome = 0
                for b in bits:
                    pattern |= 1 << b
                    syndrome ^= shifted[b]
                found[syndrome].append((max(0, weight - radius), pattern))
        self.first = np.cumsum([0] + [len(x) for x in found])[:-1]
        self.patterns = np.array([p for x in found for _, p in x], dtype=np.int64)
        self.excess = np.array([e for x in found for e, _ in x], dtype=np.int64)
        #: by syndrome and allowance: patterns whose excess is within it
        self.within = np.array([[sum(e <= a for e, _ in x) for a in range(more + 1)] for x in found], dtype=np.int64)

    @staticmethod
    def _sums(parts: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(parts), dtype=np.int64)
        for i, x in enumerate(parts):
            out[1 << i : 2 << i] = out[: 1 << i] ^ x
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & ((1 << self.half) - 1)] ^ self.high[words >> self.half]


class Covering:
    """Anchors of 64-bit fingerprints for a threshold."""

    def __init__(self, threshold: int, blocks: int = 2):
        self.threshold = threshold
        golay = PerfectCode(23, 0b101011100011, 3, threshold)
        self.codes = [golay, golay] + ([PerfectCode(15, 0b10011, 1, threshold)] if blocks == 3 else [])

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home): every anchor that a point within the threshold of a fingerprint can have."""
        row = np.arange(len(fps))
        anchor = np.zeros(len(fps), dtype=np.int64)
        used = np.zeros(len(fps), dtype=np.int64)
        shift = 0
        for code in self.codes:
            words = ((fps >> np.uint64(shift)) & np.uint64((1 << code.length) - 1)).astype(np.int64)
            syndrome = code.syndrome(words)[row]
            n = code.within[syndrome, self.threshold - used]
            again = np.repeat(np.arange(len(row)), n)
            at = code.first[syndrome[again]] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            row, used = row[again], used[again] + code.excess[at]
            # a codeword of a cyclic code is known by its upper bits
            anchor = anchor[again] << (code.length - code.degree) | (words[row] ^ code.patterns[at]) >> code.degree
            shift += code.length
        return row, anchor, used == 0


def link_fingerprints(fps: DataFrame, threshold: int = 2, blocks: int | None = None) -> DataFrame:
    """Pairs a < b of the distinct values in column fp that differ in at most `threshold` bits."""
    if blocks is None:
        blocks = 3 if fps.count() > LARGE else 2

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covering = Covering(threshold, blocks)
        for part in parts:
            values = part.column(0).to_numpy()
            for at in range(0, len(values), 2_000):
                own = values[at : at + 2_000]
                row, anchor, home = covering.anchors(own.view(np.uint64))
                yield pa.record_batch([pa.array(anchor), pa.array(own[row]), pa.array(home)], names=["anchor", "fp", "home"])

    visits = fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")
    homes = visits.where("home").select("anchor", F.col("fp").alias("a"))
    guests = visits.select("anchor", F.col("fp").alias("b"))
    # Spark takes the visits for as small as the fingerprints they are made of and would send them all, 61 times as many, to every task
    guests = guests.hint("merge")
    # a point's anchor sees all within the threshold of it, so each pair is found at the smaller one's
    return homes.join(guests, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b").distinct()


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (64 bits in a long) of each whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            fps = np.array([fingerprint(t, words) for t in text_bytes(part.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([part.column(0), pa.array(fps)], names=[key, "fp"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def simhash_groups(docs: DataFrame, words: int = 3, threshold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fp and component_id (the least key reachable over links of at most `threshold` bits) of each row.

    Texts without words, null ones too, have fingerprint 0 and are linked like any others. Repeated rows share a
    group. Null keys belong to groups but never name one, unless a group has no other. Other columns are not read. An
    empty table gives no rows.
    """
    own = stored(fingerprints(docs, words, text, key), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    edges = stored(link_fingerprints(classes, threshold), "fingerprint-links")
    labels = connected_components(edges)
    named = classes.drop("n").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(named, "fingerprint-labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = stored(join_unique(named.select("fp", "label"), least, ["label"]).select("fp", "component_id"), "fingerprint-groups")
    return join_unique(own, groups, ["fp"], classes).select(key, "fp", "component_id")


#: Anchors of a text, and minimal hashes of its shingles that make one. Texts of a Jaccard similarity j share none with
#: probability (1 - j ** DEPTH) ** BANDS, however they differ: 3e-6 at 0.8, 1e-8 at 0.85.
BANDS, DEPTH = 32, 5
_SEED = 20
#: Visitors of an anchor that are paired in one block.
PAIR_BLOCK = 512
#: Keys of near copies that are sent to all tasks (16 MB of them); with more, texts are shuffled to them.
MOST_SENT = 1 << 20


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; a shorter text is one shingle, without words none."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) > words else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), dtype=np.uint64))


class MinHashes:
    """Anchors of shingle sets: each combines DEPTH minima of the set under as many hash functions."""

    def __init__(self):
        rng = np.random.default_rng(_SEED)
        self.mul, self.add, self.mix = (rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (BANDS * DEPTH, BANDS * DEPTH, (BANDS, DEPTH)))
        self.band = rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)

    def anchors(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 1_024):
            x = hashes[at : at + 1_024, None] * self.mul + self.add
            # low bits of a product depend on low bits only, so the high ones are folded in and multiplied again
            x = (x ^ x >> np.uint64(32)) * self.mul
            least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
        y = (least.reshape(BANDS, DEPTH) * self.mix)
        y = ((y ^ y >> np.uint64(31)) * self.mix).sum(axis=1, dtype=np.uint64) + self.band
        return (y ^ y >> np.uint64(30)).view(np.int64)


def _shingled(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """key, s (128-bit hash of the set of shingles), fp (SimHash) and anchors of each whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = MinHashes()
        for part in text_slices(parts, 1):
            digests, fps, anchors = [], [], []
            for t in text_bytes(part.column(1)):
                hashes = shingle_hashes(t, words)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fps.append(fingerprint(t, words))
                anchors.append(minima.anchors(hashes))
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.record_batch([part.column(0), pa.array(digests, pa.binary()), fp, pa.array(anchors, pa.list_(pa.int64()))], names=[key, "s", "fp", "anchors"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, s binary, fp long, anchors array<long>")


def covered_visits(classes: DataFrame, threshold: int = 2) -> DataFrame:
    """Visits (anchor, node) of the nodes whose fingerprints (fp) the covering code links: one for each node of a group of several.

    Groups are the connected components of fingerprints within `threshold` bits, as in simhash_groups.
    """
    sizes = stored(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "covered-fingerprints")
    labels = connected_components(stored(link_fingerprints(sizes, threshold), "fingerprint-links"))
    groups = sizes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 OR label IS NOT NULL")
    groups = stored(groups.select("fp", F.xxhash64(F.lit("fp"), F.coalesce("label", "fp")).alias("anchor"), "n"), "covered-groups")
    return join_unique(classes.select("node", "fp"), groups.select("fp", "anchor"), ["fp"], groups).select("anchor", "node")


class ShingleSets:
    """Sets of shingle hashes of documents, for those of their keys that are asked for."""

    def __init__(self, docs: DataFrame, words: int, similarity: float, text: str, key: str):
        self.texts = docs.select(F.col(key).alias("node"), F.col(text).cast("string").alias("text"))
        self.words, self.similarity = words, similarity
        self.kept: DataFrame | None = None

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and h of the nodes (distinct, in a stored table)."""
        words = self.words

        def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(parts, 1):
                sets = [shingle_hashes(t, words).view(np.int64) for t in text_bytes(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "h"])

        wanted = F.broadcast(nodes) if nodes.count() <= MOST_SENT else nodes
        return stored(self.texts.join(wanted, "node", "left_semi").mapInArrow(shingle, f"node {dict(nodes.dtypes)['node']}, h array<long>"), "shingle-sets")

    def bounds(self, nodes: DataFrame) -> DataFrame:
        """node, size and most, the number of its shingles that any other of the nodes has; keeps their sets for similar()."""
        self.kept = self.of(nodes)
        # a key may be repeated with other texts, so sets are told apart by a hash of their own
        sets = self.kept.withColumn("set", F.xxhash64("node", "h"))
        once = sets.select("set", F.explode("h").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("set")).where("n = 1")
        alone = once.groupBy("set").agg(F.count(F.lit(1)).alias("alone"))
        sizes = sets.select("node", "set", F.size("h").alias("size")).join(alone, "set", "left")
        return sizes.select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("most"))

    def possible(self, nodes: DataFrame) -> DataFrame:
        """Pairs of different labels of nodes (node, label) that bounds() was asked for, whose sets can be similar."""
        # a key may be repeated with other texts, so sets are told apart by a hash of their own
        own = stored(self.kept.join(nodes, "node").withColumn("set", F.xxhash64("node", "h")).dropDuplicates(["set"]), "open-sets")
        met = possible_pairs(own.select(F.col("set").alias("node"), "label", "h"), math.floor(100 * self.similarity))
        x, y = (own.select(F.col("set").alias(c), F.col("node").alias(n)) for c, n in (("a", "x"), ("b", "y")))
        return met.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def similar(self, met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets have a Jaccard similarity of at least `similarity`."""
        similarity, kind = self.similarity, dict(met.dtypes)["a"]

        def agree(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                near = []
                for i in range(part.num_rows):
                    x, y = (part.column(c)[i].values.to_numpy() for c in (2, 3))
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                    near.append(both >= similarity * (len(x) + len(y) - both))
                yield part.filter(pa.array(near, pa.bool_())).select(["a", "b"])

        sets = self.kept
        if sets is None:
            sets = self.of(stored(met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met-nodes"))
        # sets are too large to be sent to all tasks; the rows of a hot leader are split by adaptive execution
        met = met.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        return met.select("a", "b", "ha", "hb").mapInArrow(agree, f"a {kind}, b {kind}")


def linked_at_anchors(
    visits: DataFrame, decide: Callable[[DataFrame], DataFrame], bounds: Callable[[DataFrame], DataFrame], similarity: float, pairs: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """node and label (least node of the group) of each linked node, from anchor visits (anchor, node; no repeats).

    decide keeps the pairs (a, b) that are linked. Any two visitors of an anchor are decided, unless links found before
    join them or bounds say that they can't be linked:
    1. The visitors of each anchor are compared with one of them, so near copies cost their rows.
    2. Of anchors that still hold several groups, bounds gives each visitor's size and the most that it can share with
       any other visitor there. Who can't reach the similarity leaves; the rest is compared with the visitor that shares
       most of its own, which of many edited copies is the least edited one.
    3. The pairs of different groups that are left are decided: those that `pairs` gives for the nodes and labels that
       are left, or without it those of each anchor where both bounds allow the similarity.
    """
    total = (visits := stored(visits, "anchor-visits")).count()
    shared = stored(visits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-anchors")
    visits = stored(join_apart(visits, shared, ["anchor"], total), "shared-visits")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    first = visits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("to"))
    seen = stored(join_apart(visits, first, ["anchor"], total).where("node <> to").select(*pair("node", "to")).distinct(), "met-pairs")
    edges = stored(decide(seen).select("a", "b"), "similar-links")
    labels = connected_components(edges)
    live = _open_visits(visits, labels, total)
    if live is None:
        return labels

    reach = stored(bounds(stored(live.select("node").distinct(), "open-nodes")).where(F.col("most") >= similarity * F.col("size")), "set-bounds")
    live = stored(live.join(reach, "node"), "open-visits")
    central = F.max(F.struct((F.col("most") / F.col("size")).alias("share"), F.xxhash64("node").alias("h"), "node", "label", "size", "most"))
    lead = live.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), central.alias("c")).select("anchor", "n", "c.node", "c.label", "c.size", "c.most").toDF("anchor", "n", "to", "other", "size2", "most2")
    met = join_apart(live, lead, ["anchor"], total).where((F.col("label") != F.col("other")) & _possible("size", "most", "size2", "most2", similarity))
    met = stored(met.select(*pair("node", "to")).distinct().join(seen, ["a", "b"], "left_anti"), "met-pairs")
    found, seen = stored(decide(met).select("a", "b"), "similar-links"), seen.union(met)
    if not found.isEmpty():
        edges = edges.union(found)
        labels = connected_components(edges)
    live = _open_visits(live.drop("label"), labels, total)
    if live is None:
        return labels
    met = pairs(stored(live.select("node", "label").distinct(), "open-labels")) if pairs else _open_pairs(live, similarity, total).distinct()
    met = stored(met.join(seen, ["a", "b"], "left_anti"), "met-pairs")
    found = stored(decide(met).select("a", "b"), "similar-links")
    return labels if found.isEmpty() else connected_components(edges.union(found))


def _open_visits(visits: DataFrame, labels: DataFrame, total: int) -> DataFrame | None:
    """visits, with labels, of anchors that hold several groups; None if there are none."""
    node_type = dict(visits.dtypes)["node"]
    live = stored(visits.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node").cast(node_type)), "labelled-visits")
    groups = live.groupBy("anchor", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("anchor").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"))
    at = stored(groups.where("groups > 1").select("anchor", "n"), "open-anchors")
    return None if at.isEmpty() else stored(join_apart(live, at, ["anchor"], total), "open-visits")


def _possible(size: str, most: str, size2: str, most2: str, similarity: float) -> Column:
    """Can sets of two sizes, of which at most so many are shared with others, have this Jaccard similarity?"""
    shared = F.least(most, most2)
    return shared >= similarity * (F.col(size) + F.col(size2) - shared)


def _open_pairs(live: DataFrame, similarity: float, total: int) -> DataFrame:
    """Possible pairs a < b of nodes of different labels, each at the least anchor that both visit.

    Large anchors are cut into blocks, joined two by two.
    """
    live = live.join(live.groupBy("node").agg(F.array_sort(F.collect_set("anchor")).alias("anchors")), "node")
    sizes = live.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    live = join_apart(live, sizes, ["anchor"], total)
    own = live.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = own.select("anchor", F.col("own").alias("i"), F.col("at").alias("j"), F.col("node").alias("a"), F.col("label").alias("x"), F.col("size").alias("s1"), F.col("most").alias("m1"), F.col("anchors").alias("v1"))
    b = own.select("anchor", F.col("at").alias("i"), F.col("own").alias("j"), F.col("node").alias("b"), F.col("label").alias("y"), F.col("size").alias("s2"), F.col("most").alias("m2"), F.col("anchors").alias("v2"))
    apart = (F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & _possible("s1", "m1", "s2", "m2", similarity)
    apart &= F.col("anchor") == F.array_min(F.array_intersect("v1", "v2"))
    return a.join(b, ["anchor", "i", "j"]).where(apart).select("a", "b")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and component_id of each row, linking texts whose sets of shingles have a Jaccard similarity of at least `similarity`.

    Candidates are texts whose SimHashes are in one group of the covering code (covered_visits), and texts that share one
    of BANDS anchors, each made of minimal hashes of their shingles: near copies whose SimHashes are further apart than a
    sparse code covers meet there. Whether two texts meet depends on the similarity of their shingle sets alone, not on where or how they differ. Any two visitors
    of an anchor are compared by their sets of 64-bit shingle hashes, in one group already, or too full of shingles that
    nobody shares (linked_at_anchors).

    Texts with equal sets, all texts without words too, are one class from the start. Null keys have
    no component (null). Repeated rows share one. Other columns are not read. An empty table gives no rows.
    """
    own = stored(_shingled(docs, words, text, key), "shingled")
    classes = stored(own.where(F.col(key).isNotNull()).groupBy("s").agg(F.min_by(F.struct(F.col(key).alias("node"), "fp", "anchors"), F.struct(key, "fp")).alias("x")).select("s", "x.*"), "shingle-classes")
    visits = classes.select(F.explode("anchors").alias("anchor"), "node").union(covered_visits(classes)).distinct()
    sets = ShingleSets(docs, words, similarity, text, key)
    labels = linked_at_anchors(visits, sets.similar, sets.bounds, similarity, sets.possible)
    named = stored(classes.join(labels, "node", "left").select("s", F.coalesce("label", "node").alias("component_id")), "shingle-groups")
    return join_unique(own.select(key, "s"), named, ["s"], how="left").select(key, F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that are near copies of a row with a smaller key; rows with a null key all stay.

    Of repeated rows with the least key of a group all stay, as they cannot be told apart by key.
    """
    groups = similar_groups(docs, words, similarity, text, key)
    gone = stored(groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct(), "near-copies")
    if gone.count() <= MOST_SENT:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def op8_simhash(spark, sf_dir):
    groups = simhash_groups(documents(spark, sf_dir), words=3, threshold=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
