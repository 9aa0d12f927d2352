"""Document quality by regularised quadratic discriminant analysis.

Each document gives a vector of transformed statistics of its whole text (shares are variance-stabilised by the
arcsine of the root, sizes by the logarithm). Class means and covariances are summed over all labelled rows allowed
for learning; each covariance is shrunk towards the pooled one and towards its diagonal. Scores come from the
difference of the two log densities, with the Mahalanobis terms solved on Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc32, stored, table, text_bytes, text_slices

FEATURES = ("log_words", "log_word_length", "symbols", "upper", "digits", "stops", "bangs", "repeats", "distinct", "dup_lines", "marked_words", "long_words")
#: Shrinkage of a class covariance to the pooled one, and of the result to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
#: Least variance of a feature within a class.
FLOOR = 1e-4
#: Characters, words and lines of usual text that a document's own are joined by, so that a few words say little.
CHARS, WORDS, LINES = 60, 12, 8
#: Documents at or above are taken for good.
THRESHOLD = 0.3

_SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\/"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_STOPS, _BANGS = b".,;:", b"!?"


def statistics(text: bytes) -> list[float]:
    """Raw statistics in the order of FEATURES; shares come from (count, of how many, usual ones added, usual share)."""
    words = text.split()
    n, size = len(words), len(text)
    lacks = lambda of: size - len(text.translate(None, of))
    symbols, letters = lacks(_SYMBOLS), lacks(_LETTERS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = sum(map(len, words))
    ends = [w[-1:] for w in words]
    marked = sum(1 for e in ends if e in _ENDS)
    pairs = [
        (symbols, size, CHARS, 0), (lacks(_UPPER), letters, CHARS, 0.03), (lacks(_DIGITS), size, CHARS, 0), (lacks(_STOPS), size, CHARS, 0.02), (lacks(_BANGS), size, CHARS, 0),
        (sum(map(eq, words, words[1:])), n, WORDS, 0), (len(set(words)), n, WORDS, 0.9), (len(lines) - len(set(lines)), len(lines), LINES, 0), (marked, n, WORDS, 0),
        (sum(1 for w in words if len(w) > 30), n, WORDS, 0),
    ]
    return [float(n), (chars + 5.0 * WORDS) / (n + WORDS), *((k + more * usual) / (m + more) for k, m, more, usual in pairs)]


_ENDS = {bytes([x]) for x in _SYMBOLS + _BANGS}


def transformed(raw: np.ndarray) -> np.ndarray:
    out = np.arcsin(np.sqrt(np.clip(raw, 0, 1)))
    out[:, :2] = np.log1p(raw[:, :2])
    return out


class Discriminant:
    """Two Gaussian classes with shrunk covariances; keeps their Cholesky factors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """sums: by class, the number of rows, the sum of vectors and the sum of their outer products."""
        d = len(FEATURES)
        self.known = {c: s for c, s in sums.items() if s[0] >= 1}
        self.n = sum(s[0] for s in self.known.values())
        if not self.known:
            return
        scatter = {c: s[2] - np.outer(s[1], s[1]) / s[0] for c, s in self.known.items()}
        pooled = sum(scatter.values()) / max(1.0, self.n - len(self.known))
        self.mean, self.factor, self.log_norm = {}, {}, {}
        for c, s in self.known.items():
            own = scatter[c] / max(1.0, s[0] - 1)
            w = TO_POOLED + (1 - TO_POOLED) * d / (d + s[0])  # few rows: more of the pooled one
            cov = (1 - w) * own + w * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
            self.factor[c] = np.linalg.cholesky(cov)
            self.mean[c] = s[1] / s[0]
            self.log_norm[c] = np.log(s[0] / self.n) - np.log(np.diag(self.factor[c])).sum()

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; one known class gives 0 or 1, none gives 0.5."""
        if len(self.known) < 2:
            return np.full(len(x), float(next(iter(self.known))) if self.known else 0.5)
        log = {}
        for c in (0, 1):
            z = np.linalg.solve(self.factor[c], (x - self.mean[c]).T)
            log[c] = self.log_norm[c] - 0.5 * (z * z).sum(axis=0)
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and x, the transformed statistics of each whole text; null texts are empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            raw = np.array([statistics(t) for t in text_bytes(part.column(1))], dtype=float).reshape(-1, len(FEATURES))
            yield pa.record_batch([part.column(0), pa.array(list(transformed(raw)), pa.list_(pa.float64()))], names=[key, "x"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant:
    """Sums over all rows of stats that have a label of 0 or 1; only one small row for each sum reaches the driver."""
    d = len(FEATURES)
    learned = stats.join(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("label")), key).select("label", "x")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for part in parts:
            if part.num_rows:
                x = np.array(part.column(1).flatten()).reshape(-1, d)
                y = part.column(0).to_numpy()
                for c in (0, 1):
                    own = x[y == c]
                    total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.record_batch([pa.array(at // total.shape[1], pa.int32()), pa.array(at % total.shape[1], pa.int32()), pa.array(total.ravel())], names=["label", "i", "v"])

    rows = learned.mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + d + d * d))
    for r in rows:
        flat[r.label, r.i] = r.v
    return Discriminant({c: (flat[c, 0], flat[c, 1 : 1 + d], flat[c, 1 + d :].reshape(d, d)) for c in (0, 1)})


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score and predicted of each row.

    Learns only from labelled rows whose crc32(key as text) mod folds is not held_fold. Empty and null texts have the
    statistics of an empty text and get its score; a null key is held out; repeated rows get a row each (and weigh
    more in learning, as do repeated labels). Only key and text are read. Without any label all scores are 0.5; an
    empty table gives no rows.
    """
    stats = stored(document_statistics(docs, text, key), "quality-stats")
    held = F.coalesce(id_crc32(F.col(f"`{key}`"), folds) == held_fold, F.lit(True))
    model = fit(stats.where(~held), labels, key)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = model.scores(np.array(part.column(2).flatten()).reshape(-1, len(FEATURES)))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return stats.select(key, held.alias("held_out"), "x").mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose text scores at least THRESHOLD, with the columns of docs.

    Statistics are taken twice, to learn and to score, so that no text is shuffled to a label or a verdict.
    Rows with a null text are scored as empty texts; other columns pass through unread.
    """
    import pyspark.sql.types as T

    stats = stored(document_statistics(docs, text, key), "quality-stats")
    held = F.coalesce(id_crc32(F.col(f"`{key}`"), 5) == 0, F.lit(True))
    model = fit(stats.where(~held), labels, key)
    at = docs.columns.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, at):
            raw = np.array([statistics(t) for t in text_bytes(part.column(at))], dtype=float)
            yield part.filter(pa.array(model.scores(transformed(raw)) >= THRESHOLD))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op10_quality_classifier(spark, sf_dir):
    return score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
