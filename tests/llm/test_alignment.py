"""Cross-tokenizer alignment against a plain walk over both tokenisations of each whole text."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from oracle import SMALL

from tidemark.llm import alignment, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "a\r\nb\n\n", "é ü Ünïcödé", "日本語 テスト", "x<|endoftext|>y <|startoftext|> <s> </s> <unk> <0x0A>", "it's we'll 's 12 3.5, a.,b", "ab" * 3000, "\x1c a\x1fb", "=" * 70_000, "a  b\t c ", "▁ a", "a▁b c", "\x00 a", "ß ΑΣ. İ", " lead", "trail ", "　 x", "🙂 🙂🙂", "wordªº, x", "a" * 300_000]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteTokenizer(BYTES), alignment.PieceTokenizer(PIECES)


def plain_groups(sides, text):
    """The groups of a text as two lists of ids each; none for texts that aren't spelled byte by byte."""
    if not text:
        return []
    a, b = sides
    x, y, whole = a.tokenizer.encode(f" {text}", add_special_tokens=False).ids, b.processor.encode(text), f" {text}".encode()
    if b"".join(a.bytes[i] for i in x) != whole or b"".join(b.bytes[i] for i in y) != whole:
        return []
    groups, i, j, at, bt = [], 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if at == bt:
            groups.append(([], []))
        if at <= bt:
            groups[-1][0].append(x[i])
            at, i = at + len(a.bytes[x[i]]), i + 1
        else:
            groups[-1][1].append(y[j])
            bt, j = bt + len(b.bytes[y[j]]), j + 1
    return groups


def plain(sides, texts):
    found, held = [], Counter()
    for t in texts:
        groups = plain_groups(sides, t)
        links = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            for p in cx:
                for q in cy:
                    links[p, q] += cx[p] * cy[q]
        held.update(links.keys())
        found.append((groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), digest))
    return out


@pytest.mark.parametrize("most", [alignment.MOST_SENT, 40, 0])
def test_odd_texts(spark, sides, most):
    rnd = random.Random(1)
    texts = [*ODD, *("".join(rnd.choice("ab '\ns.1\t é=!\xa0日 \x85🙂") for _ in range(rnd.randint(0, 30))) for _ in range(400)), "ab b", "ab b"]
    rows = [(None if i == len(texts) - 1 else i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs int").repartition(3)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(docs, BYTES, PIECES, most=most).collect()}
    want = plain(sides, texts)
    assert found == {r[0]: w for r, w in zip(rows, want, strict=True)}
    assert found[None] == found[len(texts) - 2]  # a repeated text


def test_whole_table(spark, sides):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, SMALL).collect()}
    assert found == {r.doc_id: w for r, w in zip(docs, plain(sides, [r.text for r in docs]), strict=True)}


def test_memories_are_bounded(sides, monkeypatch):
    """What is forgotten or kept changes no result."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé.") for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(3000)], k=200)) for _ in range(60)]
    free = [x[:5] for x in alignment.Aligner(*sides).align(texts)]
    monkeypatch.setattr(alignment, "REMEMBERED", 400_000)
    tight = alignment.Aligner(*sides)
    assert [x[:5] for k in range(0, 60, 5) for x in tight.align(texts[k : k + 5])] == free
    assert len(tight.words) < len(set(" ".join(texts).split(" ")))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(docs, BYTES, PIECES).count() == 0
