"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from oracle import SMALL, connect, same
from pyspark.sql import functions as F

from tidemark.llm import ann, common, components, language_id, line_dedup, mixing, packing, quality_qda, quality_rules, simhash, suffix_dedup, token_count
from tidemark.llm.queries import ORACLES, QUERIES

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a", "a\r\nb\n\n", "é ü Ünïcödé", "日本語 テスト", "x<|endoftext|>y <|startoftext|>", "it's we'll 's 12 3.5, a.,b", "ab" * 3000, "\x1c a\x1fb", "=" * 500, "a  b\t c ", "ß ΑΣ. İ"]


def documents(spark, texts, extra=None):
    """doc_id (one null), text and columns whose names clash with what operators add."""
    rows = [(None if i == len(texts) - 1 else i, t, "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string, copy_no int, fp int")


def corpus(seed, n=60, words=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeioutnrsl") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, words))) for _ in range(n)]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, name):
    same(QUERIES[name](spark, SMALL), connect(SMALL), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_mixing_is_poisson(spark):
    df = spark.createDataFrame([(i, "a" if i < 3000 else None, "t") for i in range(4000)], "doc_id long, source string, copy_no string")
    out = mixing.mix_sources(df, {"a": 0.5}, total=40_000).select("doc_id", "source", "copy_no", "n_copies").collect()
    sizes = Counter(r.source for r in out)
    assert abs(sizes["a"] - 20_000) < 600 and abs(sizes[None] - 20_000) < 600
    counts = Counter(r.n_copies for r in out if r.copy_no == 1 and r.source == "a")
    rate = 20_000 / 3000
    for k in (4, 6, 9):
        want = 3000 * math.exp(-rate) * rate**k / math.factorial(k)
        assert abs(counts[k] - want) < 5 * math.sqrt(want)
    assert [r for r in out if r.copy_no > r.n_copies] == []
    large = mixing.mix_sources(df.limit(2), {"a": 1.0}, total=4_000).count()  # mean 2000: a sum of parts
    assert abs(large - 4_000) < 350


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *corpus(1), *corpus(1), "w " * 500]
    window = 64
    out = packing.pack_documents(documents(spark, texts), WORDS, window, end_id=2, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    pieces = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
    for i, t in enumerate(texts):
        own = sorted(pieces[None if i == len(texts) - 1 else i], key=lambda r: r.start)
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert all(a == sum(n for _, n in s[:k]) for k, (a, _) in enumerate(s)) and sum(n for _, n in s) <= window
    assert len(sequences) <= 1.05 * sum(r.length for r in out) / window + 1


def test_best_fit_is_tightest():
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 100) for _ in range(400)), reverse=True)
    fit, rooms = packing.BestFit(100), []
    for n in lengths:
        fitting = [r for r in rooms if r >= n]
        window, offset = fit.place(n)
        if fitting:
            assert 100 - offset == min(fitting)
            rooms[window] -= n
        else:
            assert window == len(rooms) and offset == 0
            rooms.append(100 - n)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    texts = [*ODD, *corpus(2), *("".join(rnd.choice("ab '\ns.1\t é=!\xa0日") for _ in range(rnd.randint(0, 30))) for _ in range(500)), "end"]
    got = by_id(token_count.count_tokens(documents(spark, texts), BYTES, 100), "n_bytes", "n_tokens", "over_limit")
    tokenizer = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[None if i == len(texts) - 1 else i] == (len((t or "").encode()), n, n > 100)


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_odd_texts(spark):
    rows = [(i, "the of and " * 3, "en") for i in range(40)] + [(100 + i, "der die das ", "de") for i in range(40)] + [(200, None, "en"), (201, "12 !", None), (202, "", "en"), (None, "der das", "de")]
    got = by_id(language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "lang_pred", "held_out")
    assert got[200][0] == got[201][0] == got[202][0] == "und" and got[None] == ("de", True) and got[0][0] == "en" and got[100][0] == "de"
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify_languages(unlabelled).first().lang_pred == "und"


@pytest.mark.parametrize("most_sent", [1 << 20, 0])
def test_line_dedup(spark, most_sent):
    rnd = random.Random(3)
    pool = ["Shared line", " shared LINE\t", "ÉTÉ", "été", "", " ", "x"] + [f"own {i}" for i in range(200)]
    texts = [*ODD, *("\n".join(rnd.choice(pool[:7] if rnd.random() < 0.4 else pool) for _ in range(rnd.randint(1, 8))) for _ in range(60)), "shared line\nshared line"]
    found = Counter(k for t in texts for k in {x.strip(b" \t\n\x0b\x0c\r").lower() for x in (t or "").encode().split(b"\n")})
    out = line_dedup.drop_shared_lines(documents(spark, texts), 10, most_sent=most_sent)
    assert out.columns == ["doc_id", "text", "copy_no", "fp", "n_lines", "n_dropped"]
    got = by_id(out, "text", "n_lines", "n_dropped")
    for i, t in enumerate(texts):
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not x.strip(b" \t\n\x0b\x0c\r") or found[x.strip(b" \t\n\x0b\x0c\r").lower()] < 10]
        want = None if t is None else b"\n".join(kept).decode()
        assert got[None if i == len(texts) - 1 else i] == (want, len(lines), len(lines) - len(kept))
    assert sum(n for _, _, n in got.values()) > 20


def repeats(texts, length):
    found = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if found[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield bytes(b for b, g in zip(t, gone, strict=True) if not g), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())


@pytest.mark.parametrize("large,buffer", [(50_000, 97), (3, 1 << 20)])
def test_suffix_dedup(spark, large, buffer):
    rnd = random.Random(5)
    random_text = lambda n, of="abcdefgh": "".join(rnd.choice(of) for _ in range(n))
    base = random_text(300)
    texts = [None, "", "é" * 60, "é" * 60, "ab" * 70]
    for _ in range(40):
        k = rnd.random()
        a = rnd.randint(0, 200)
        edited = list(base)
        for _ in range(rnd.randint(0, 4)):
            edited[rnd.randrange(300)] = "z"
        texts.append(random_text(rnd.randint(0, 50)) + base[a : a + rnd.randint(20, 100)] + random_text(rnd.randint(0, 50)) if k < 0.3 else "".join(edited) if k < 0.5 else random_text(rnd.randint(0, 150), "ab" if k < 0.6 else "abcdefgh"))
    texts.append(texts[-1])
    got = by_id(suffix_dedup.remove_repeats(documents(spark, texts), 20, large=large, bucket=50, buffer=buffer), "kept", "spans")
    for i, (kept, spans) in enumerate(repeats([(t or "").encode() for t in texts], 20)):
        g = got[None if i == len(texts) - 1 else i]
        assert bytes(g[0]) == kept and len(g[1]) == spans


def test_suffix_dedup_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "xyz"), (1, "b" * 3), (1, "a" * 10 + "xyz")], "doc_id long, text string")
    assert sorted(bytes(r.kept) for r in suffix_dedup.remove_repeats(df, 6).collect()) == [b"", b"", b"bbb"]


def test_suffix_dedup_of_a_common_header(spark):
    """10,000 texts that begin with the same 64 bytes, in pairs that share 420 more."""
    rnd = random.Random(21)
    random_text = lambda n: bytes(rnd.choices(b"abcdefgh", k=n)).decode()
    header = random_text(64)
    texts = []
    for _ in range(5_000):
        body = random_text(420)
        texts += [header + body + random_text(30), header + body + random_text(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, bucket=500).collect()
    # the next byte is the same by chance in one pair of eight
    same = lambda i: next(n for n in range(484, 515) if n == 514 or texts[i][n] != texts[i ^ 1][n])
    assert all(bytes(r.kept).decode() == texts[r.doc_id][same(r.doc_id) :] for r in out) and len(out) == 10_000
    suffixes = df.select(F.col("text").cast("binary").alias("right"))
    sizes = [r["count"] for r in suffix_dedup._dealt(suffixes, 500, 400).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1_000 and len(sizes) > 15


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (3000, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words)
    assert [tuple(words[i]) for i in order] == sorted(map(tuple, words))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 16)).astype(np.float32)
    x[300:500] = x[7]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(800)] + [(900, None, "e"), (1000, [0.0] * 16, "e"), (1100, [float("nan")] * 16, "e"), (1200, [None] + [1.0] * 15, "e"), (1300, [1.0], "e")]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 100 == 0).collect()
    got = defaultdict(dict)
    for r in out:
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 800, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(800), d)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for i, s in found.values())
        hits += len({i for i, _ in found.values()} & set(order))
        if 300 <= q < 500:
            assert [found[k][0] for k in range(1, 11)] == order
    assert hits / 80 >= 0.9


def test_nearest_neighbours_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    hits = total = 0
    found = defaultdict(set)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 10 == 0).collect():
        found[r.query_id].add(r.vec_id)
    for i in np.nonzero(ids % 10 == 0)[0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hits += len(set(ids[np.argsort(d)[:10]]) & found[ids[i]])
        total += 10
    assert hits / total >= 0.9


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("rows", [[1.0, 100.0], [1.0, 100.0, -50.0], [5.0]])
def test_nearest_neighbours_of_few_rows_far_apart(spark, rows):
    """With k or fewer other rows all are returned."""
    out = ann.nearest_neighbours(vectors(spark, [[v] * 16 for v in rows]), F.lit(True)).collect()
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in out}
    want = {}
    for i, a in enumerate(rows):
        others = sorted((round(4 * abs(a - b), 9), j) for j, b in enumerate(rows) if j != i)
        want |= {(i, n + 1): (j, d) for n, (d, j) in enumerate(others)}
    assert got == want and len(out) == len(want)


@pytest.mark.parametrize("block", [2, 4_096])
def test_nearest_neighbours_of_outliers_and_scales(spark, monkeypatch, block):
    """Outlying queries and clusters of other scales: exactly ten each; small blocks lead to second probes, large ones to all blocks."""
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1501, 16))
    x[1000:] = rng.standard_normal((501, 16)) * rng.choice([0.3, 1.3], (501, 1)) + 2
    x[0] *= 100
    x[100] = 1000
    x = x.astype(np.float32).astype(float)
    found = ann._searched(vectors(spark, x), F.col("vec_id") % 50 == 0, 10, "vec_id", "embedding").collect()
    got, hits = defaultdict(list), 0
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == list(range(0, 1501, 50)) and {len(v) for v in got.values()} == {10}
    assert {r.asked for r in found} >= {1, 3} and (block > 2 or 2 in {r.asked for r in found})
    for q, ids in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hits += len({i for i in np.argsort(d, kind="stable")[:11] if i != q} & set(ids))
    assert hits / (10 * len(got)) >= 0.9


def test_nearest_neighbours_of_repeated_rows_and_ids(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(1, [2.0, 0.0])] + [(2, [3.0, 0.0])] * 2 + [(3, [4.0, 0.0])]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") > 1, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 2.0)]


def test_nearest_neighbours_gives_small_batches(spark, monkeypatch):
    """However many queries a batch holds, what is given out at once is bounded, and no query's vector goes along with each of its buckets."""
    kind = type(spark.range(0))
    given = kind.mapInArrow

    def watched(df, f, schema):
        def bounded(parts):
            for part in f(parts):
                assert part.nbytes < 6 << 20
                yield part

        return given(df, bounded, schema)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    x = np.random.default_rng(4).standard_normal((3_000, 64)).astype(np.float32)
    out = ann.nearest_neighbours(vectors(spark, x), F.lit(True), k=3)
    assert out.count() == 9_000


def test_nearest_neighbours_of_split_parts(spark, monkeypatch):
    """How vectors are dealt to parts and blocks, here of one bucket that fills many, changes nothing."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[200:] = x[0] + rng.standard_normal((700, 16)).astype(np.float32) / 1_000
    found = lambda: sorted(map(tuple, ann._searched(vectors(spark, x), F.col("vec_id") % 30 == 0, 10, "vec_id", "embedding").collect()))
    whole = found()
    monkeypatch.setattr(ann, "PART", 8 * 16 * 40)
    assert found() == whole and len(whole) == 300


@pytest.mark.parametrize("matrix", [40, 1 << 20])
def test_nearest_of_a_block(monkeypatch, matrix):
    """Only visited buckets are compared; many ties, and more pairs than are held at once, change nothing."""
    monkeypatch.setattr(ann, "MATRIX", matrix)
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(6)
    x, q = rng.integers(0, 3, (200, 4)).astype(np.float32), rng.integers(0, 3, (30, 4)).astype(float)
    ids, bucket = rng.permutation(200), rng.integers(0, 6, 200).astype(np.int32)
    visits = [rng.choice(9, rng.integers(0, 9), replace=False).astype(np.int32) for _ in q]
    block = ann.Block([bucket[:50], bucket[50:]], [ids[:50], ids[50:]], [x[:50], x[50:]])
    got = defaultdict(list)
    for query, i, d in zip(*block.nearest(np.arange(100, 130), q, np.concatenate(visits), np.repeat(np.arange(30), [len(v) for v in visits]), 5), strict=True):
        got[query - 100].append((d, i))
    for j, v in enumerate(visits):
        met = np.isin(bucket, v)
        assert got[j] == sorted(zip(np.sqrt(((x[met] - q[j]) ** 2).sum(axis=1)), ids[met], strict=True))[:5]


def groups(fps, ids, threshold):
    kinds = sorted(set(fps))
    root = {f: f for f in kinds}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for f, d in zip(fps, ids, strict=True):
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [least.get(find(f)) for f in fps]


def test_simhash(spark):
    texts = [*ODD, *corpus(6, 30, 12), *corpus(6, 30, 12), "A b C", "a B c", "end"]
    got = simhash.simhash_groups(documents(spark, texts), 3, 2).collect()

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = [None if i == len(texts) - 1 else i for i in range(len(texts))]
    fps = [fingerprint(t) for t in texts]
    want = dict(zip(ids, zip(fps, groups(fps, ids, 2), strict=True), strict=True))
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == want
    by_jvm = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h % (1 << 64)
    assert by_jvm == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_of_one_hot_fingerprint(spark):
    """Half of all rows have no words, and a component has many fingerprints: beyond LEAST_HOT rows both are joined apart."""
    texts = ["" if i % 2 else f"same words here {i // 4}" for i in range(6_000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs, 3, 2).collect()}
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    kinds = sorted(set(fps))
    least = dict(zip(kinds, groups(kinds, [fps.index(f) for f in kinds], 2), strict=True))
    assert got == {i: (f, least[f]) for i, f in enumerate(fps)}


def test_join_unique_keeps_what_a_join_keeps(spark):
    rows = spark.createDataFrame([(i % 3 if i < 3_000 else i % 700, i) for i in range(5_000)], "k long, i long")
    values = spark.createDataFrame([(k, -k) for k in range(1, 600)], "k long, v long")
    for how in ("inner", "left"):
        key = lambda r: (r.k, r.i)
        plain = sorted(rows.join(values, "k", how).collect(), key=key)
        assert sorted(common.join_unique(rows, values, ["k"], how=how).select("k", "i", "v").collect(), key=key) == plain


@pytest.mark.parametrize("blocks", [2, 3])
def test_covering_finds_all_links(spark, blocks):
    rnd = random.Random(9)
    fps = set()
    for _ in range(60):
        f = rnd.getrandbits(64)
        for _ in range(4):
            fps.add(f)
            for _ in range(rnd.randint(1, 3)):
                f ^= 1 << rnd.randrange(64)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.link_fingerprints(df, 2, blocks).collect()}
    want = {(signed(a), signed(b)) for a in fps for b in fps if signed(a) < signed(b) and (a ^ b).bit_count() <= 2}
    assert got == want and want


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_quality_rules(spark):
    texts = [*ODD, *corpus(7, 40, 120), "word " * 60, " ".join(corpus(8, 1, 200)) + " ### $$$", "\n".join(["one line here"] * 30), "end"]
    got = by_id(quality_rules.apply_rules(documents(spark, texts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {j for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        base = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        g = got[None if i == len(texts) - 1 else i]
        assert g[:6] == (*base, failed) and not (failed and g[6])


def test_quality_rules_are_native(spark):
    plan = quality_rules.op9_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op10_quality_classifier"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in out)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_quality_of_odd_tables(spark):
    docs = documents(spark, [*ODD, *corpus(1)])
    labels = spark.createDataFrame([(20, 1), (20, None), (21, None)], "doc_id long, quality int")
    assert {r.score for r in quality_qda.score_quality(docs, labels.where("quality > 5")).collect()} == {0.5}
    assert {r.score for r in quality_qda.score_quality(docs, labels).collect()} <= {1.0, 0.5}
    assert quality_qda.keep_good(docs, labels).columns == docs.columns


def test_discriminant_is_gaussian():
    rng = np.random.default_rng(2)
    d = len(quality_qda.FEATURES)
    x = {c: rng.standard_normal((4000, d)) * (1 + c) + c for c in (0, 1)}
    model = quality_qda.Discriminant({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()})
    right = [(model.scores(v) >= 0.5).mean() == pytest.approx(c, abs=0.1) for c, v in x.items()]
    assert all(right)


def test_digest_of_kept_text(spark):
    rows = QUERIES["op6_suffix_dedup"](spark, SMALL).collect()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in rows:
        assert r.n_bytes == len(texts[r.doc_id])
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()


def test_similar_groups(spark):
    rnd = random.Random(12)
    texts, origin = [], []
    for g, text in enumerate(corpus(13, 25, 1)):
        words = [f"{text}{rnd.randrange(400)}" for _ in range(200)]
        for k in range(rnd.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(k and 2):
                copy[rnd.randrange(200)] = f"edit{rnd.random()}"
            texts.append(" ".join(copy))
            origin.append(g)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, [*texts, "", None, "end"])).collect()}
    first = {}
    for i, g in enumerate(origin):
        first.setdefault(g, i)
    assert all(got[i] == first[g] for i, g in enumerate(origin))
    assert got[len(texts)] == got[len(texts) + 1] == len(texts) and got[None] is None


def test_every_pair_at_an_anchor_is_decided(spark, monkeypatch):
    """Visitors that are not linked to their leaders, among themselves and with those that are."""
    linked = {(2, 3), (3, 4), (1, 5), (5, 6), (10, 11)}
    visits = spark.createDataFrame([(7, i) for i in range(1, 12)] + [(8, i) for i in (2, 6, 9)], "anchor long, node long")
    decide = lambda met: met.where(" OR ".join(f"a = {a} AND b = {b}" for a, b in linked))
    for block in (2, 512):
        monkeypatch.setattr(simhash, "PAIR_BLOCK", block)
        out = simhash.linked_at_anchors(visits, decide, lambda nodes: nodes.selectExpr("node", "10 AS size", "10 AS most"), 0.8)
        assert {r.node: r.label for r in out.collect()} == {2: 2, 3: 2, 4: 2, 1: 1, 5: 1, 6: 1, 10: 10, 11: 10}


def test_similar_groups_of_many_edited_copies(spark):
    """A group in which half of all pairs lie below the similarity: as by all pairs, though most are ruled out by bounds."""
    rnd = random.Random(23)
    base = [f"w{rnd.randrange(10**9)}" for _ in range(150)]
    texts = []
    for i in range(250):
        words = list(base)
        for _ in range(rnd.randint(1, 6)):
            words[rnd.randrange(150)] = f"edit{rnd.randrange(400)}"
        texts.append(" ".join(words))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    root = list(range(250))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(250):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(simhash.similar_groups(docs), "component_id") == {i: (find(i),) for i in range(250)}
    kept = simhash.ShingleSets(docs, 5, 0.8, "text", "doc_id")
    bounds = {r.node: (r.size, r.most) for r in kept.bounds(docs.select(F.col("doc_id").alias("node"))).collect()}
    found = Counter(x for s in sets for x in s)
    assert bounds == {i: (len(s), sum(found[x] > 1 for x in s)) for i, s in enumerate(sets)}


def test_similar_groups_of_replaced_passages(spark):
    """An appended, replaced or dropped passage, at a shingle similarity just over 0.8."""
    rnd = random.Random(17)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = []
    for g in range(150):
        words = new(300)
        copy = [words + new(70), words[:100] + new(28) + words[128:], words[:-57]][g % 3]
        a, b = (set(zip(*[w[i:] for i in range(5)], strict=False)) for w in (words, copy))
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        texts += [" ".join(words), " ".join(copy)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, [*texts, "end"])).collect()}
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_similar_groups_are_exact(spark):
    """Pairs on either side of a shingle similarity of 0.8."""
    rnd = random.Random(19)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts, near = [], []
    for _ in range(200):
        words = new(200)
        copy = words + new(rnd.randint(30, 90))
        a, b = (set(zip(*[w[i:] for i in range(5)], strict=False)) for w in (words, copy))
        near.append(len(a & b) >= 0.8 * len(a | b))
        texts += [" ".join(words), " ".join(copy)]
    assert 20 < sum(near) < 180
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, [*texts, "end"])).collect()}
    assert [got[2 * g] == got[2 * g + 1] for g in range(len(near))] == near


def test_covering_sends_no_visits_to_all_tasks(spark):
    """Visits are 61 times the fingerprints, which alone are small enough to be sent."""
    rnd = random.Random(6)
    fps = [rnd.getrandbits(64) - (1 << 63) for _ in range(3_000)]
    fps += [x ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63) for x in fps[:200]]
    fps = np.array(sorted(set(fps)), dtype=np.int64)
    links = simhash.link_fingerprints(common.stored(spark.createDataFrame([(x,) for x in fps.tolist()], "fp long"), "fps"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    x, y = np.nonzero(np.triu(np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 2, 1))
    assert {(r.a, r.b) for r in links.collect()} == set(zip(fps[x].tolist(), fps[y].tolist(), strict=True)) and len(x) > 100


def test_near_copies_meet_by_covered_fingerprints(spark):
    """Nodes whose SimHashes the covering code links, over others too, visit one anchor; those by themselves none."""
    rows = [(1, 0), (2, 0b11), (3, 0b1111), (4, 0b1111), (5, -1), (6, 0x0F0F0F), (7, -4)]
    found = simhash.covered_visits(spark.createDataFrame(rows, "node long, fp long"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.anchor, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4], [5, 7]]


def test_packing_remembers_a_word_once():
    """Neither case nor a stop makes another word of it, and ids are those of the library."""
    tokens = packing.WordTokens(WORDS)
    texts = ["Été été ÉTÉ. été, the The. THE, x", "ab%%% a.b 5. it's. 'll. a1b22c?! the,.\n the.\t the.", "\xa0the.\x85a \x0b b. ", "Œuvre. İx, Σς. the.", "", " ", ". , a", "it's the. 'S a@b.c-7. \x01\x7f"]
    for text in texts:
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert {w for w in [*tokens, *tokens.new] if w.lower().rstrip(".,") == "été"} == {"été"}
