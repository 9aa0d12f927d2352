"""MinHash near-duplicates by an inverted join over signature coordinates.

A text's signature holds, for each of HASHES hash functions, the least hash of its shingles; two signatures agree in a
coordinate with a probability equal to their sets' Jaccard similarity. Each text is posted under the pair of a coordinate
and its value. Two texts can only agree in MATCHES coordinates if

* each has that many postings that it shares with anybody: who has fewer is skipped, and
* they meet in the prefix of both: in one order of all postings, rarest first, the first (shared - MATCHES + 1) of each.

So only prefixes are merged. Of those that meet in one, collisions are counted over all postings, and pairs with
MATCHES or more are decided by their full sets.

Texts of equal sets are one class from the start. A posting list may still hold thousands of edited copies, so its
visitors choose one of them, the one whose postings most others share, which of many edited copies is the least edited;
each text is compared with the most central of those that its lists chose. In a large family many copies agree with its
origin in all coordinates, and one that leads in its place leaves out what is similar to the origin alone. So visitors of
lists that hold several groups after that are compared once more, each with the most central text by full sets, and only
then paired by full sets (setjoin): a pair is made only if the elements that both can share suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, join_apart, join_unique, stored, text_bytes, text_slices
from .components import connected_components
from .setjoin import leader_pairs, pairs_between, prefix_elements

#: Coordinates of a signature, and how many of them near copies agree in at least. Texts of similarity 0.8 miss it with
#: probability 2e-8 (binomial), more similar ones more rarely.
HASHES, MATCHES = 32, 12
#: Rounds in which the visitors of a posting are compared with one of them.
ROUNDS = 2
#: Keys of candidates that are sent to all tasks; with more, texts are shuffled to them.
MOST_SENT = 1 << 20
_SEED = 12


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; a shorter text is one shingle, without words none."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) > words else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), dtype=np.uint64))


def digest(hashes: np.ndarray) -> bytes:
    """A 128-bit hash of a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


class Signatures:
    """Postings of sets: the least hash under each function, mixed with the function's number."""

    def __init__(self):
        rng = np.random.default_rng(_SEED)
        self.mul, self.add, self.salt = (rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1) for _ in range(3))

    def postings(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 2_048):
            x = hashes[at : at + 2_048, None] * self.mul + self.add
            # low bits of a product depend on low bits only, so the high ones are folded in and multiplied again
            x = (x ^ x >> np.uint64(32)) * self.mul
            least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
        y = (least ^ self.salt) * np.uint64(0x9E3779B97F4A7C15)
        return (y ^ y >> np.uint64(31)).view(np.int64)


def signed(docs: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n (size of the set), s (digest of the set, null if it is empty) and postings of each whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        for part in text_slices(parts, 1):
            sets = [shingle_set(t, words) for t in text_bytes(part.column(1))]
            some = [len(x) > 0 for x in sets]
            digests = [digest(x) if y else None for x, y in zip(sets, some, strict=True)]
            posted = [signatures.postings(x) if y else None for x, y in zip(sets, some, strict=True)]
            yield pa.record_batch([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(posted, pa.list_(pa.int64()))], names=[key, "n", "s", "postings"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n long, s binary, postings array<long>")


class FullSets:
    """Decides pairs of classes by the full sets of their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, text: str, key: str):
        self.texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        self.classes = classes.select("node", "key", "s")
        self.words, self.percent = words, percent

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and h of the given nodes: texts are found again by a key of their class, and told apart by digests."""
        words = self.words

        def shingle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(parts, 0):
                sets = [shingle_set(t, words) for t in text_bytes(part.column(0))]
                yield pa.record_batch([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["s", "h"])

        wanted = stored(self.classes.join(nodes, "node"), "wanted-classes")
        keys = wanted.select(F.col("key").alias("k")).distinct()
        keys = F.broadcast(keys) if wanted.count() <= MOST_SENT else keys
        found = self.texts.join(keys, self.texts["key"].eqNullSafe(F.col("k")), "left_semi").select("text").mapInArrow(shingle, "s binary, h array<long>")
        return stored(found.join(wanted.select("s", "node"), "s").select("node", "h"), "full-sets")

    def similar(self, met: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a stored table, whose sets have a Jaccard similarity of `percent` or more."""
        return self.decided(met, self.of(met.select(F.explode(F.array("a", "b")).alias("node")).distinct()))

    def decided(self, met: DataFrame, sets: DataFrame) -> DataFrame:
        """The same from the sets (node, h) of at least the nodes that are met."""
        percent = self.percent

        def agree(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                near = []
                for i in range(part.num_rows):
                    x, y = (part.column(c)[i].values.to_numpy() for c in (2, 3))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.filter(pa.array(near, pa.bool_())).select(["a", "b"])

        # sets are too large to be sent to all tasks; the pairs of a node that many are compared with are split by adaptive execution
        met = met.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        return met.select("a", "b", "ha", "hb").mapInArrow(agree, "a long, b long")


def posting_lists(classes: DataFrame) -> DataFrame:
    """node, n, weight (how often its postings are shared), postings (those that others share, rarest first) and prefix of the classes that can agree with others."""
    posts = classes.select("node", "n", F.explode("postings").alias("post"))
    total = posts.count()
    shared = stored(posts.groupBy("post").agg(F.count(F.lit(1)).alias("held")).where("held > 1").withColumn("rarity", F.col("held")), "shared-postings")
    met = join_apart(posts, shared, ["post"], total, "held")
    lists = met.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rarity", "post"))).alias("x")).where(F.size("x") >= MATCHES)
    weight = F.aggregate("x.rarity", F.lit(0).cast("long"), lambda n, r: n + r).alias("weight")
    lists = lists.select("node", "n", weight, F.col("x.post").alias("postings"))
    return stored(lists.withColumn("prefix", F.slice("postings", F.lit(1), F.size("postings") - (MATCHES - 1))), "posting-lists")


def _pair(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _sizes_allow(x: str, y: str, percent: int):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _open(visits: DataFrame, total: int) -> DataFrame:
    """Those of the visits (post, node, label, weight, led) whose posting holds several groups."""
    groups = visits.groupBy("post", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("post").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"))
    at = stored(groups.where("groups > 1").select("post", "n"), "open-postings")
    return stored(join_apart(visits, at, ["post"], total), "open-visits")


def link_groups(lists: DataFrame, sets: FullSets, percent: int) -> DataFrame:
    """node and label (least node of the group) of each linked node."""
    visits = lists.select("node", F.col("node").alias("label"), "weight", F.lit(False).alias("led"), F.explode("prefix").alias("post"))
    total = visits.count()
    a, b = (lists.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("postings").alias(f"p{c}")) for c in "ab")
    collide = F.size(F.array_intersect("pa", "pb")) >= MATCHES
    live, labels, edges, seen = _open(visits, total), None, None, None
    for _ in range(ROUNDS):
        # the most central visitor that is in no group of an earlier leader of this posting
        to = F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node", "label"))
        lead = live.where("NOT led").groupBy("post").agg(to.alias("x")).select("post", F.col("x.node").alias("to"), F.col("x.label").alias("other"), F.col("x.weight").alias("central"))
        lead = stored(lead.join(live.groupBy("post").agg(F.count(F.lit(1)).alias("n")), "post"), "leaders")
        # a node meets the most central of its postings' leaders and not each of them, so a round makes no more pairs than nodes
        best = F.max(F.struct("central", F.xxhash64("to").alias("h"), "to"))["to"].alias("to")
        met = join_apart(live, lead, ["post"], total).where("label <> other").groupBy("node").agg(best).select(*_pair("node", "to")).distinct()
        met = met if seen is None else met.join(seen, ["a", "b"], "left_anti")
        met = stored(met.join(a, "a").join(b, "b").where(_sizes_allow("na", "nb", percent) & collide).select("a", "b"), "met-pairs")
        seen = met if seen is None else seen.union(met)
        found = stored(sets.similar(met), "similar-links")
        edges = found if edges is None else edges.union(found)
        labels = connected_components(edges) if labels is None or not found.isEmpty() else labels
        new = live.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of = lead.join(labels.withColumnRenamed("node", "to"), "to", "left").select("post", F.coalesce("label", "to").alias("of"), "n")
        live = _open(join_apart(stored(new, "labelled-visits"), stored(of, "led-labels"), ["post"], total).withColumn("led", F.col("led") | (F.col("label") == F.col("of"))).drop("of"), total)
        if live.isEmpty():
            return labels
    nodes = stored(live.select("node").distinct(), "open-nodes")
    open_sets = stored(sets.of(nodes).dropDuplicates(["node"]), "open-sets")
    prefix = prefix_elements(open_sets, percent)
    for pairs in (leader_pairs, pairs_between):
        now = stored(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "open-labels")
        met = stored(pairs(prefix, now, percent).join(seen, ["a", "b"], "left_anti"), "met-pairs")
        seen = seen.union(met)
        found = stored(sets.decided(met, open_sets), "similar-links")
        if not found.isEmpty():
            edges = edges.union(found)
            labels = connected_components(edges)
    return labels


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id and kept of each row; sets of `words`-word shingles link at a Jaccard similarity of `percent` %.

    A-Z are lower-cased; words are parted by ASCII white space; a text with fewer words is one shingle. component_id is the
    least key that can be reached, the row's own included; kept says that it is the row's own. Texts without words, null
    ones too, have no shingles and are linked with nothing. Rows with a null key are linked but never name a group, and
    are kept only if no other row of theirs has a key (component_id is null then). Repeated rows share a group and are
    all kept if one is. Other columns are not read. An empty table gives no rows.
    """
    own = stored(signed(docs, words, text, key), "signed")
    classes = own.where("s IS NOT NULL").groupBy("s").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("postings").alias("postings"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "signed-classes")
    labels = link_groups(posting_lists(classes), FullSets(docs, classes, words, percent, text, key), percent)
    named = stored(classes.select("node", "s", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "signed-labels")
    least = named.groupBy("label").agg(F.min("key").alias("component_id"))
    groups = stored(join_unique(named.select("s", "label"), least, ["label"]).select("s", "component_id"), "signed-groups")
    found = join_unique(own.select(key, "n", "s"), groups, ["s"], classes.select("s", F.col("rows").alias("n")), how="left")
    component = F.when(F.col("s").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return found.select(key, F.col("n").alias("n_shingles"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op12_minhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


OP12_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON l.a = s.doc_id"""
