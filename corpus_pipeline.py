"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next one.

run(spark, sf_dir) keeps good documents, drops lines that many documents share, keeps one document of each group of
near copies, replicates the rest to target source weights in a shuffled order, and packs it into token windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, packing, quality_qda, simhash
from tidemark.llm.common import stored, table


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, with n_chars counted anew."""
    sizes = {"n_chars": F.length("text").cast(dict(like.dtypes)["n_chars"])} if "n_chars" in like.columns else {}
    return docs.withColumns(sizes).select(like.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more."""
    return _sized(line_dedup.drop_shared_lines(docs, min_docs=10), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.keep_one_of_each(docs, words=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a shuffled order."""
    return mixing.mix_sources(docs, mixing.WEIGHTS, seed=mixing.SEED).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in windows of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mixing", mixture), ("packing", packed)]

#: The classifier, SimHash and the tokenizer are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
