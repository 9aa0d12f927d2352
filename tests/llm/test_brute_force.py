"""Classifiers against plain models that share no code with them, very long texts, and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, mixing, packing, quality_qda, quality_rules, simhash, suffix_dedup, token_count
from tidemark.llm.common import stored

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SOUNDS = {"xa": "aeiou lmnr", "yb": "äöüß kstz", "zc": "oauy bdgv"}


def invented(rnd, lang, words):
    return " ".join("".join(rnd.choice(SOUNDS[lang].replace(" ", "")) for _ in range(rnd.randint(2, 7))) for _ in range(words))


def grams(text):
    plain = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower())
    data = b" " + b" ".join(plain.encode().split()) + b" "
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_language_equals_weighted_kernel_ridge_in_its_dual(spark):
    """So few texts that all are landmarks: scores are those of a kernel ridge regression over all of them."""
    rnd = random.Random(3)
    langs = ["xa"] * 30 + ["yb"] * 20 + ["zc"] * 10
    rows = [(i, invented(rnd, lang, rnd.randint(3, 40)) + rnd.choice(["", " 12!", "\n?"]), lang) for i, lang in enumerate(langs)]
    asked = [(1000 + i, invented(rnd, rnd.choice(list(SOUNDS)), 3) + " " + invented(rnd, rnd.choice(list(SOUNDS)), 2), "no") for i in range(60)]
    asked = [r for r in asked if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(df).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    names, sets = sorted(SOUNDS), [grams(t) for _, t, _ in learned]
    known = set().union(*sets)
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    sizes = Counter(lang for _, _, lang in learned)
    w = np.array([1 / sizes[lang] for _, _, lang in learned])
    w /= w.mean()
    n, penalty = len(learned), 1e-2 * len(learned)
    y = np.array([[1.0 if lang == c else -1.0 for c in names] for _, _, lang in learned])
    system = np.block([[k + np.diag(penalty / w), np.ones((n, 1))], [penalty * np.ones((1, n)), np.array([[-1e-9]])]])
    solved = np.linalg.solve(system, np.vstack([y, np.zeros((1, len(names)))]))
    for i, text, _ in rows + asked:
        own = grams(text) & known
        f = np.array([kernel(own, s) for s in sets]) @ solved[:-1] + solved[-1]
        assert abs(got[i][1] - np.clip((f.max() + 1) / 2, 0, 1)) < 1e-3
        if np.sort(f)[-1] - np.sort(f)[-2] > 1e-3:
            assert got[i][0] == names[int(f.argmax())]


def quality_features(text):
    count = lambda of: sum(text.count(c.encode()) for c in of)
    words = text.split()
    n, size = len(words), len(text)
    marks = "#*$%&|<>@^~_=+{}[]\\/"
    upper = sum(65 <= b <= 90 for b in text)
    letters = upper + sum(97 <= b <= 122 or b > 127 for b in text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda k, m, more=0.0, of=60: math.asin(math.sqrt(min(1, (k + of * more) / (m + of))))
    return [
        math.log1p(n), math.log1p((sum(map(len, words)) + 60) / (n + 12)), share(count(marks), size), share(upper, letters, 0.03), share(count("0123456789"), size),
        share(count(".,;:"), size, 0.02), share(count("!?"), size), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n, of=12), share(len(set(words)), n, 0.9, 12),
        share(len(lines) - len(set(lines)), len(lines), of=8), share(sum(chr(x[-1]) in marks + "!?" for x in words), n, of=12), share(sum(len(x) > 30 for x in words), n, of=12),
    ]


def test_quality_equals_two_gaussians(spark):
    rnd = random.Random(5)
    texts = []
    for i in range(120):
        good = lambda: invented(rnd, "xa", rnd.randint(4, 12)).capitalize() + "."
        bad = lambda: rnd.choice(["BUY NOW!!!", "$ #1", invented(rnd, "zc", 3), "click click"])
        texts.append("\n".join((bad if rnd.random() < (0.5 if i % 3 == 0 else 0.2) else good)() for _ in range(rnd.randint(1, 9))))
    texts += ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    x = np.array([quality_features((t or "").encode()) for t in texts])
    used = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    own = {c: x[[i for i in used if int(i % 3 > 0) == c]] for c in (0, 1)}
    scatter = {c: (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for c, v in own.items()}
    pooled = (scatter[0] + scatter[1]) / (len(used) - 2)
    log = {}
    for c, v in own.items():
        w = 0.1 + 0.9 * 12 / (12 + len(v))
        cov = (1 - w) * scatter[c] / (len(v) - 1) + w * pooled
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-4 * np.eye(12)
        d = x - v.mean(axis=0)
        log[c] = math.log(len(v) / len(used)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    got = {r.doc_id: r for r in quality_qda.score_quality(df, labels).collect()}
    assert all(abs(got[i].score - want[i]) < 1e-8 and got[i].predicted == int(want[i] >= 0.3) for i in range(len(texts)))
    assert {r.doc_id for r in quality_qda.keep_good(df, labels).collect()} == {i for i in range(len(texts)) if want[i] >= 0.3}
    assert len({round(v, 3) for v in want}) > 20


@pytest.fixture(scope="module")
def long_texts():
    """Three texts of 5 MB: lines of words, the same again, and one without a space or line break."""
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("aeioutnrslüß") for _ in range(rnd.randint(1, 9))) for _ in range(5_000)]
    words = rnd.choices(vocabulary, k=900_000)
    lines = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    return [lines, "short", lines, bytes(rnd.choices(b"abcdefghijkl", k=5_000_000)).decode(), None, ""]


@pytest.fixture
def long_docs(spark, long_texts):
    return spark.createDataFrame([(i, t, "xa" if i % 2 else "yb") for i, t in enumerate(long_texts)], "doc_id long, text string, lang string").repartition(2)


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_long_texts_are_counted_and_packed(long_docs, long_texts):
    from tokenizers import Tokenizer

    texts = [t if t is None or " " in t or len(t) < 10 else t[:300_000] for t in long_texts]  # the library's time grows fast without spaces
    docs = long_docs.withColumn("text", F.when(F.col("doc_id") == 3, F.substring("text", 1, 300_000)).otherwise(F.col("text")))
    library = Tokenizer.from_file(BYTES)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert by_id(token_count.count_tokens(docs, BYTES, 1024), "n_tokens", "over_limit") == {i: (n, n > 1024) for i, n in want.items()}
    library, found = Tokenizer.from_file(WORDS), defaultdict(dict)
    for r in packing.pack_documents(docs, WORDS, 4096, 2, with_ids=True).collect():
        found[r.doc_id][r.start] = r.ids
    for i, t in enumerate(texts):
        assert [x for s in sorted(found[i]) for x in found[i][s]] == [*library.encode(t or "", add_special_tokens=False).ids, 2]


def test_long_texts_are_deduplicated(spark, long_docs, long_texts):
    shared = long_texts[0].split("\n")[7]
    few = spark.createDataFrame([(100 + i, f"{shared}\nown {i}", "xa") for i in range(9)], long_docs.schema)
    got = by_id(line_dedup.drop_shared_lines(long_docs.union(few), 10), "n_lines", "n_dropped")
    n = long_texts[0].count("\n") + 1
    same = long_texts[0].split("\n").count(shared)
    assert got[0] == got[2] == (n, same) and got[3] == (1, 0) and got[4] == got[5] == (1, 0) and got[104] == (2, 1)
    done = by_id(suffix_dedup.remove_repeats(long_docs), "n_bytes", "kept")
    assert [len(done[i][1]) for i in range(6)] == [0, 5, 0, 5_000_000, 0, 0] and done[0][0] == len(long_texts[0].encode())
    prints = by_id(simhash.simhash_groups(long_docs), "fp", "component_id")
    words = long_texts[0].lower().split()
    counts = np.zeros(64, dtype=np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], dtype="<u8")
    for b in range(64):
        counts[b] = int((hashes >> np.uint64(b) & np.uint64(1)).sum())
    assert prints[0][0] % (1 << 64) == sum(1 << b for b in range(64) if 2 * counts[b] > len(hashes))
    assert prints[2] == prints[0] and prints[0][1] == 0 and prints[4] == prints[5] == (0, 4)
    groups = by_id(simhash.similar_groups(long_docs), "component_id")
    assert groups[0] == groups[2] == (0,) and groups[3] == (3,)


def test_long_texts_are_judged(spark, long_docs, long_texts):
    got = by_id(quality_rules.apply_rules(long_docs), "n_words", "word_chars", "n_dup_lines", "n_repeat_words")
    words = long_texts[0].split()
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {j for k in range(len(words) - 2) if seen[words[k], words[k + 1], words[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = long_texts[0].split("\n")
    assert got[0] == got[2] == (900_000, sum(map(len, words)), len(lines) - len(set(lines)), len(twice)) and got[3] == (1, 5_000_000, 0, 0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    scores = by_id(quality_qda.score_quality(long_docs, labels), "score")
    assert scores[0] == scores[2] and all(0 <= s <= 1 for (s,) in scores.values())
    langs = by_id(language_id.identify_languages(long_docs), "lang_pred", "score")
    assert langs[0][0] == langs[2][0] and abs(langs[0][1] - langs[2][1]) < 1e-4 and langs[4] == langs[5] == ("und", 0.0)


def test_repeated_rows(spark):
    """Each repeated row gives a row; in op5 each counts as a document."""
    rows = [(1, "a line\nown", "xa")] * 6 + [(2, "a line", "yb")] * 4 + [(None, "other words", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(token_count.count_tokens(docs, BYTES, 1).collect(), key=str) == sorted([r for r in token_count.count_tokens(docs, BYTES, 1).distinct().collect() for _ in range({1: 6, 2: 4, None: 2}[r.doc_id])], key=str)
    assert Counter(r.doc_id for r in language_id.identify_languages(docs).collect()) == {1: 6, 2: 4, None: 2}
    assert Counter((r.doc_id, r.n_words) for r in quality_rules.apply_rules(docs).collect()) == {(1, 3): 6, (2, 2): 4, (None, 2): 2}
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    assert Counter(r.doc_id for r in quality_qda.score_quality(docs, labels).collect()) == {1: 6, 2: 4, None: 2}
    lines = line_dedup.drop_shared_lines(docs, 10).collect()
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in lines) == {(1, "own", 1): 6, (2, "", 1): 4, (None, "other words", 0): 2}


def test_mixing_of_odd_rows(spark):
    """Empty and null texts, null ids and repeated rows: copies follow the id alone."""
    rows = [(i, t, s) for i in (None, 1, 2, 2) for t in ("", None) for s in ("a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, {"a": 0.5}, total=4_000).collect()
    counts = Counter((r.doc_id, r.text, r.source) for r in out)
    each = defaultdict(set)
    for (i, t, s), n in counts.items():
        each[i, s].add(n // (2 if i == 2 else 1))
    assert len(counts) == 12 and all(len(v) == 1 for v in each.values()) and abs(len(out) - 4_000) < 1_500


def test_mixing_of_many_sources(spark, monkeypatch):
    """With more sources than are sent to all tasks, one of them large: the same copies."""
    rows = [(i, "t", "big" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}") for i in range(3_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n int").withColumn("size", F.lit("x"))
    key = lambda r: (r.doc_id, r.copy_no)
    sent = sorted(mixing.mix_sources(docs, {"big": 0.2}, seed=1).collect(), key=key)
    monkeypatch.setattr(mixing, "MOST_SENT", 0)
    assert sorted(mixing.mix_sources(docs, {"big": 0.2}, seed=1).collect(), key=key) == sent and len(sent) > 2_500


def test_language_of_clashing_columns_and_ties(spark):
    rows = [(i, "abc abc", lang, 1.0, "x") for i, lang in enumerate(["p", "q"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    out = language_id.identify_languages(docs).collect()
    assert out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"} and {r.lang_pred for r in out} <= {"p", "q"} and len({(r.lang_pred, r.score) for r in out}) == 1


def test_order_of_rules_is_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # stored first: a filter pushed below the projections would repeat their array functions
    sample = stored(quality_rules.base_counts(docs, "text", "doc_id"), "counts").where("NOT base_failed")
    measured = quality_rules.measured_rules(sample)
    names = [r.name for r in quality_rules.ordered_rules(sample)]
    assert names == [r.name for r in quality_rules.ordered_rules(sample.repartition(3))] and sorted(names) == sorted(r.name for r in quality_rules.RULES)
    rates = {r.name: (n + 0.5) / w for r, n, w in measured}
    assert names == sorted(names, key=lambda x: -rates[x]) and min(w for _, _, w in measured) == 1.0 and max(w for _, _, w in measured) > 50


def test_digests_follow_the_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 900), (2, "y" + "x" * 450), (3, "short")], "doc_id long, text string")
    got = by_id(suffix_dedup.remove_repeats(docs), "kept", "spans")
    assert [hashlib.sha256(bytes(got[i][0])).hexdigest() for i in (1, 2, 3)] == [hashlib.sha256(t).hexdigest() for t in (b"", b"y", b"short")]
    assert [[(s.start, s.end) for s in got[i][1]] for i in (1, 2, 3)] == [[(0, 900)], [(1, 451)], []]
