"""The pipeline held against a plain-Python version, stage by stage and as a whole."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import SMALL

import corpus_pipeline
from tidemark.llm import mixing, quality_qda

SPACE = b" \t\n\x0b\x0c\r"


def good(docs, labels):
    x = {i: quality_qda.transformed(np.array([quality_qda.statistics((t or "").encode())]))[0] for i, (t, _) in docs.items()}
    sums = {}
    for c in (0, 1):
        own = np.array([x[i] for i, q in labels if q == c and i in x and zlib.crc32(str(i).encode()) % 5])
        sums[c] = (len(own), own.sum(axis=0), own.T @ own)
    model = quality_qda.Discriminant(sums)
    return {i: d for i, d in docs.items() if model.scores(x[i][None])[0] >= 0.3}


def without_lines(docs):
    key = lambda line: line.strip(SPACE).lower()
    found = Counter(k for t, _ in docs.values() for k in {key(x) for x in t.encode().split(b"\n")})
    keep = lambda t: b"\n".join(x for x in t.encode().split(b"\n") if not key(x) or found[key(x)] < 10).decode()
    return {i: (keep(t), s) for i, (t, s) in docs.items()}


def one_of_each(docs):
    """The least id of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8, by all pairs."""
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shingles = {}
    for i, (t, _) in docs.items():
        w = t.encode().lower().split()
        shingles[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if shingles[a] == shingles[b] or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: d for i, d in docs.items() if find(i) == i}


def unit(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def mixed(docs):
    sizes = Counter(s for _, s in docs.values())
    listed = sum(mixing.WEIGHTS[s] for s in sizes if s in mixing.WEIGHTS)
    rest = (1 - listed) / max(1, sum(s not in mixing.WEIGHTS for s in sizes))
    out = Counter()
    for i, (_, s) in docs.items():
        rate = mixing.WEIGHTS.get(s, rest) * len(docs) / sizes[s]
        u, k, p = unit(f"draw{mixing.SEED}", i, 1), 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        if k:
            out[i] = k
    return out


@pytest.fixture(scope="module")
def plain(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    docs = {r.doc_id: (r.text, r.source) for r in rows}
    steps = [good(docs, labels)]
    steps.append(without_lines(steps[-1]))
    steps.append(one_of_each(steps[-1]))
    return steps, mixed(steps[-1])


def test_stages(spark, plain):
    steps, copies = plain
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "mixing", "packing"]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], steps, strict=False):
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id: (r.text, r.source) for r in rows} == want and len(rows) == len(want)
        assert all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.STAGES[3][1](spark, docs, SMALL)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == copies


def test_run(spark, plain):
    from tokenizers import Tokenizer

    steps, copies = plain
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*tokenizer.encode(steps[-1][i][0], add_special_tokens=False).ids, 2], dtype="<u4")
        for at in range(0, len(ids), 4096):
            want[i, at, zlib.crc32(ids[at : at + 4096].tobytes()), len(ids)] += n
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = defaultdict(int)
    for r in rows:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 4096


def test_odd_rows_pass_the_stages(spark, tmp_path):
    """Nulls in every column, an extra column, an empty text and a table without rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    rows = [(None, None, None, None, None, None), (1, "", "en", "a", 0, "x"), (2, "some plain words of a text. " * 20, None, None, 3, None), (2, "some plain words of a text. " * 20, None, None, 3, None)]
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            assert stage(spark, docs, str(tmp_path)).count() <= 3 * len(table)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(table)


def test_run_returns_the_packed_ids(spark):
    """Windows can be filled from the result alone."""
    windows = defaultdict(dict)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        windows[r.sequence_id][r.offset] = r.ids
    for pieces in windows.values():
        assert sorted(pieces) == list(np.cumsum([0] + [len(pieces[o]) for o in sorted(pieces)])[:-1])
