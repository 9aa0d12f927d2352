"""Hard negatives against all scores, computed plainly."""

import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, target int"


def plain(rows, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    """rows: (id, vector, label). Result rows as sets; an id's own rows are never its partners."""
    size = defaultdict(int)
    good = []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v), label))
            size[len(v)] += 1
    dim = min(size, key=lambda d: (-size[d], d), default=0)
    good = sorted({g for g in good if len(g[1]) == dim})
    out = set()
    for i, v, label in good:
        if not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in good if j != i))
        seen = list(dict.fromkeys((s, j) for s, j, other in scored if other == label))
        for s, j in seen[:positives]:
            fit = list(dict.fromkeys((t, k) for t, k, other in scored if other != label and low * -s <= 100 * -t <= high * -s))
            out |= {(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fit[:negatives])}
    return out


def mined(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(parts)
    found = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect()
    assert len(found) == len(set(map(tuple, found)))
    return set(map(tuple, found))


def vectors(seed, n=300, dim=24, labels=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.standard_normal((labels, dim)) * 0.2
    own = rnd.integers(0, labels, n)
    x = centre[own] + centre[rnd.integers(0, labels, n)] + 0.3 * rnd.standard_normal((n, dim))
    return [(i, x[i].astype(np.float32).tolist(), int(own[i])) for i in range(n)]


@pytest.mark.parametrize(("seed", "block"), [(1, 8192), (2, 16), (3, 7)])
def test_equals_all_scores(spark, seed, block):
    rows = vectors(seed)
    found = mined(spark, rows, block=block)
    assert found == plain(rows, lambda i: i % 10 == 0) and len(found) > 100


def test_odd_rows(spark):
    """Nulls, other lengths, zero vectors, ties, repeats, one vector held by half of the rows, one id with two labels."""
    rnd = random.Random(4)
    rows = [(i, [float(rnd.randint(-2, 2)) / 256 for _ in range(8)], rnd.randint(0, 2)) for i in range(120)]  # many ties
    rows += [(200 + i, [0.01] * 8, i % 2) for i in range(150)]
    rows += [rows[0], rows[10], (20, rows[21][1], 1), (None, [0.5] * 8, 1), (400, None, 1), (410, [0.5] * 8, None), (420, [0.5] * 7 + [None], 1), (430, [float("nan")] * 8, 0), (440, [float("inf")] + [0.0] * 7, 0), (450, [0.5] * 9, 0), (460, [], 0), (470, [0.0] * 8, 0), (480, [-0.0] * 8, 0)]
    assert mined(spark, rows, block=32) == plain(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    assert mined(spark, [(0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.24], 0)]) == {(0, 1, 1, 2, 24576, 24192)} & plain([(0, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.24], 0)], lambda i: i % 10 == 0)
    assert mined(spark, [(0, [0.5, 0.5], 1)]) == set() == mined(spark, [], parts=1)


def test_bounds_hold():
    rnd = np.random.default_rng(5)
    segments = hard_negatives.Segments(50)
    x = np.floor(256 * rnd.standard_normal((400, 50)) * rnd.choice([0.01, 1, 30], (400, 1)))
    mean, dev = segments.summaries(x)
    rows = np.arange(400)
    widths = []
    for level in segments.levels:
        for q in range(0, 400, 17):
            least, most = segments.bounds(level, mean, dev, rows, q, mean, dev)
            score = x @ x[q]
            assert (least <= score).all() and (score <= most).all()
        widths.append((most - least).mean())
    assert len(widths) == 3 and widths == sorted(widths, reverse=True)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = queries.QUERIES["op13_hard_negatives"](spark, SMALL).collect()
    assert set(map(tuple, found)) == plain(rows, lambda i: i % 100 == 0)
