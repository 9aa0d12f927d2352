"""MinHash near-duplicates against all pairs of full shingle sets."""

import random
from collections import Counter

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from tidemark.llm import minhash, setjoin

ODD = [None, "", " ", "\n", "a", "A", "a b", "a\tB", "a b c d", "A B C D", "é ü", "É ü", "x" * 400_000, "w " * 60_000, "w w w w"]


def plain_sets(texts, words=4):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return sets


def plain(rows, words=4, percent=80):
    """(key, n, component) of each row by all pairs and a plain union of links."""
    sets = plain_sets([t for _, t in rows], words)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(s), (least.get(root(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(rnd, words, share):
    out = list(words)
    for i in rnd.sample(range(len(out)), int(share * len(out))):
        out[i] = f"n{rnd.randrange(10**6)}"
    return out


def families(seed, n=8, copies=9, size=120):
    """Texts with copies edited word by word, cut, extended or with a passage replaced, up to both sides of the threshold, and chains of edits."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rnd.randrange(4000)}" for _ in range(size)]
        out.append(base)
        for _ in range(copies):
            kind, k = rnd.randrange(5), rnd.randint(1, 26)
            out.append({0: lambda: edited(rnd, base, rnd.choice([0.01, 0.02, 0.03, 0.05])), 1: lambda: base[k:], 2: lambda: base + [f"x{rnd.randrange(10**6)}" for _ in range(k)], 3: lambda: base[:-k] + [f"y{rnd.randrange(10**6)}" for _ in range(k)], 4: lambda: edited(rnd, out[-1], 0.02)}[kind]())
    rnd.shuffle(out)
    return [" ".join(x) for x in out]


def check(spark, rows, **more):
    docs = spark.createDataFrame([(k, t, "x", 1, True) for k, t in rows], "doc_id long, text string, n string, node int, kept boolean").repartition(3)
    found = minhash.near_duplicates(docs, **more).collect()
    assert [tuple(r) for r in found if r.kept != (r.doc_id == r.component_id)] == []
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter(plain(rows))


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(8, "a b c d"), (9, None), (None, "a b c d"), (None, "only here"), (None, None), (3, "a b c d e f g h i"), (50, "a b c d e f g h i")]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies(spark, seed):
    check(spark, list(enumerate(families(seed))))


def test_one_large_family(spark, monkeypatch):
    """Copies of one text, paired by their sets in one round and with texts shuffled to keys, beside very many equal texts."""
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    monkeypatch.setattr(minhash, "MOST_SENT", 0)
    texts = families(7, n=1, copies=60, size=80)
    check(spark, list(enumerate(texts + [texts[0]] * 300)))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(plain(rows))


def test_postings_agree_as_sets_do():
    rnd = random.Random(5)
    signatures, shares = minhash.Signatures(), []
    for _ in range(60):
        words = [b"w%d" % rnd.randrange(10**6) for _ in range(400)]
        x, y = (minhash.shingle_set(b" ".join(w), 1) for w in (words[:360], words[40:]))
        shares.append((signatures.postings(x) == signatures.postings(y)).mean())
    assert abs(sum(shares) / 60 - 0.8) < 0.02


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.near_duplicates(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).where("kept").count() == 3


@pytest.mark.parametrize("block", [setjoin.BLOCK, 3])
def test_possible_pairs_lose_none(spark, block):
    """Every similar pair of different labels is possible, and few others of a family are."""
    texts = families(11, n=3, copies=40, size=90)
    sets = [sorted(minhash.shingle_set(t.encode(), 4).view("int64").tolist()) for t in texts] + [[], [1], [1]]
    rows = [(i, i % 7 if i % 5 else -1, h) for i, h in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, label long, h array<long>").repartition(3)
    found = [tuple(r) for r in setjoin.possible_pairs(df, 80, block).collect()]
    assert len(found) == len(set(found))
    similar, pairs = set(), 0
    for i, (_, x, p) in enumerate(rows):
        for j in range(i):
            both = len(set(p) & set(rows[j][2]))
            if rows[j][1] != x:
                pairs += both > 0
                if both and 100 * both >= 80 * (len(p) + len(rows[j][2]) - both):
                    similar.add((j, i))
    assert similar and similar <= set(found) and len(found) < pairs / 2


def test_rounds_make_no_more_pairs_than_texts(spark, monkeypatch):
    """Copies edited at places of their own share most postings, each list with a leader of its own."""
    rnd = random.Random(31)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rnd.sample(range(300), 6):
            copy[at] = f"edit{rnd.randrange(10**9)}"
        texts.append(" ".join(copy))
    made, similar = [], minhash.FullSets.similar
    monkeypatch.setattr(minhash.FullSets, "similar", lambda self, met: (made.append(met.count()), similar(self, met))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert max(made[: minhash.ROUNDS]) <= len(texts)
    sets = [{tuple(t.split()[k : k + 4]) for k in range(297)} for t in texts]
    root = list(range(120))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(120)}


def test_a_family_gathers_at_its_origin(spark, monkeypatch):
    """Copies of four edits are linked with their origin alone, whose signature many copies of one edit have too."""
    rnd = random.Random(47)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(base)]
    for edits in (1, 3, 4):
        for _ in range(70):
            copy = list(base)
            for at in rnd.sample(range(3, 147, 4), edits):
                copy[at] = f"edit{rnd.randrange(10**9)}"
            texts.append(" ".join(copy))
    made, stored = [], minhash.stored

    def counted(df, name):
        out = stored(df, name)
        made.append(out.count() if name == "met-pairs" else 0)
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    check(spark, list(enumerate(texts)))
    assert sum(made) <= (minhash.ROUNDS + 2) * len(texts)
