"""Language of whole texts by a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3: a blended spectrum) that both contain, counted by
presence, over the root of the product of their own numbers. N-grams are those that occur in any landmark; a text's
presence vector over them is filled by table look-ups. Landmarks are a few labelled texts of each language. Ridge
regression on the Nyström features of a bounded sample gives one weight vector for each language over kernels with
the landmarks; as the kernel is a dot product of presence vectors, a batch's kernels and scores are matrix products.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc32, text_slices

#: Bounds of the sample that is learned from: texts and landmarks of each language.
TEXTS_EACH, LANDMARKS_EACH = 600, 48
RIDGE = 1e-2
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that become spaces: ASCII but for letters.
_PLAIN = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in range(256))
_OFFSETS = (0, 1 << 8, (1 << 8) + (1 << 16))
_CODES = (1 << 8) + (1 << 16) + (1 << 24)


def normalised(text: str) -> np.ndarray:
    plain = b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "
    return np.frombuffer(plain, dtype=np.uint8)


def gram_codes(text: str) -> list[np.ndarray]:
    """Codes of a text's 1-, 2- and 3-grams, with repeats."""
    a = normalised(text).astype(np.int32)
    b = (a[:-1] << 8) | a[1:]
    c = (b[:-1] << 8) | a[2:]
    return [a, b + _OFFSETS[1], c + _OFFSETS[2]]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class Presence:
    """Presence vectors over a vocabulary of n-gram codes."""

    def __init__(self, vocabulary: np.ndarray):
        self.size = len(vocabulary)
        self.place = np.full(_CODES, self.size, dtype=np.uint16 if self.size < 65_535 else np.int32)
        self.place[vocabulary] = np.arange(self.size)

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size + 1), dtype=np.float32)
        for i, text in enumerate(texts):
            for codes in gram_codes(text):
                out[i, self.place[codes]] = 1
        return out[:, :-1]


def normal(presence: np.ndarray) -> np.ndarray:
    return presence / np.sqrt(np.maximum(1, presence.sum(axis=1, keepdims=True)))


_made: dict[str, Presence] = {}


def _presence(vocabulary) -> Presence:
    """One table for each worker process and vocabulary (a Spark broadcast)."""
    key = str(vocabulary.value[:1].tolist()) + str(hash(vocabulary.value.tobytes()))
    if key not in _made:
        _made.clear()
        _made[key] = Presence(vocabulary.value)
    return _made[key]


class LanguageModel:
    """languages, a vocabulary of codes and, by language, weights over the vocabulary."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.weights = languages, vocabulary, weights


def _sample(docs: DataFrame, each: int, text: str, key: str, lang: str) -> DataFrame:
    """About `each` rows of every language, chosen by a hash of the key: key, text, lang, h."""
    sizes = {r[lang]: r["n"] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return docs.where(F.lit(False)).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.lit(0.0).alias("h"))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))])
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return docs.where(h < share[F.col(lang)]).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), h.alias("h"))


def fit_languages(learnable: DataFrame, texts_each: int = TEXTS_EACH, landmarks_each: int = LANDMARKS_EACH, text: str = "text", key: str = "doc_id", lang: str = "lang") -> LanguageModel:
    """Learns from a bounded sample; only n-gram codes of the landmarks and kernel rows of the sample reach the driver."""
    spark = learnable.sparkSession
    sample = _sample(learnable.select(key, text, lang), texts_each, text, key, lang)

    def codes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            found = [np.unique(np.concatenate(gram_codes(t))) if has_letter(t) else np.zeros(0, np.int32) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int32())), part.column(2)], names=["lang", "codes", "h"])

    marks = _sample(learnable.select(key, text, lang), landmarks_each, text, key, lang)
    marks = [(r.lang, r.h, np.array(r.codes, dtype=np.int64)) for r in marks.select("lang", "text", "h").mapInArrow(codes, "lang string, codes array<int>, h double").collect()]
    marks = sorted((m for m in marks if len(m[2])), key=lambda m: (m[0], m[1], len(m[2])))
    if not marks:
        return LanguageModel([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32))
    vocabulary = np.unique(np.concatenate([m[2] for m in marks]))
    landmark = np.zeros((len(marks), len(vocabulary)), dtype=np.float32)
    for i, m in enumerate(marks):
        landmark[i, np.searchsorted(vocabulary, m[2])] = 1
    landmark = normal(landmark)
    shared, sent = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(landmark)

    def kernels(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 1):
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                texts = piece.column(1).to_pylist()
                good = np.array([has_letter(t) for t in texts], dtype=bool)
                k = normal(_presence(shared).rows([t if g else "" for t, g in zip(texts, good, strict=True)])) @ sent.value.T
                yield pa.record_batch([piece.column(0), piece.column(2), pa.array(list(k), pa.list_(pa.float32()))], names=["lang", "h", "k"]).filter(pa.array(good))

    rows = sorted((r.lang, r.h, r.k) for r in sample.select("lang", "text", "h").mapInArrow(kernels, "lang string, h double, k array<float>").collect())
    languages = sorted({m[0] for m in marks})
    k = np.array([r[2] for r in rows], dtype=float).reshape(len(rows), len(marks))
    y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(languages)[None], 1.0, -1.0) if rows else np.zeros((0, len(languages)))
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(float))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: features are kernels with landmarks times this
    z = np.hstack([k @ root, np.ones((len(k), 1))])
    share = 1.0 / np.maximum(1, np.array([[r[0] == c for c in languages] for r in rows]).sum(axis=0)) if rows else np.zeros(len(languages))
    w = np.array([share[languages.index(r[0])] for r in rows]) if rows else np.zeros(0)
    w = w / w.mean() if len(w) else w
    penalty = RIDGE * max(1, len(z)) * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    coef = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (y * w[:, None]))
    over_landmarks, bias = root @ coef[:-1], coef[-1]
    return LanguageModel(languages, vocabulary, np.vstack([landmark.T @ over_landmarks, bias]).astype(np.float32))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id", extra: list | None = None) -> DataFrame:
    """key, the extra columns, lang_pred and score of each row."""
    spark = docs.sparkSession
    vocabulary, weights = spark.sparkContext.broadcast(model.vocabulary), spark.sparkContext.broadcast(model.weights)
    languages = np.array([*model.languages, UNDETERMINED], dtype=object)
    source = docs.select(F.col(text).cast("string").alias("__text"), key, *(extra or []))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(parts, 0):
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                texts = piece.column(0).to_pylist()
                best = np.full(len(texts), len(languages) - 1)
                score = np.zeros(len(texts))
                good = [i for i, t in enumerate(texts) if has_letter(t)]
                if good and len(languages) > 1:
                    f = normal(_presence(vocabulary).rows([texts[i] for i in good])) @ weights.value[:-1] + weights.value[-1]
                    best[good] = f.argmax(axis=1)
                    score[good] = np.clip((f.max(axis=1) + 1) / 2, 0, 1)
                yield pa.record_batch([*piece.columns[1:], pa.array(languages[best].tolist(), pa.string()), pa.array(score)], names=[*piece.schema.names[1:], "lang_pred", "score"])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType(source.schema.fields[1:]).add("lang_pred", "string").add("score", "double"))


def identify_languages(docs: DataFrame, folds: int = 4, held_fold: int = 2, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred and score of each row, after learning from rows outside the held fold.

    A row is held out if crc32(key as text) mod folds is held_fold, or its key is null. Null texts and texts without a
    letter are `und` with score 0, as is everything if nothing can be learned. Repeated rows get a row each; other
    columns are not read; an empty table gives no rows.
    """
    held = F.coalesce(id_crc32(F.col(f"`{key}`"), folds) == held_fold, F.lit(True))
    model = fit_languages(docs.where(~held), text=text, key=key, lang=lang)
    return predict_languages(docs, model, text, key, [held.alias("held_out")])


def op4_language_id(spark, sf_dir):
    return identify_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))
