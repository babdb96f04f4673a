"""A corpus pipeline of five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import bpe, common, exact_dedup, mixing, near_dedup, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of those given, does not reject."""
    model = quality.learn(docs, common.read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= 0.5).drop("__score")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, similarity 0.8."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them; a row taken twice is there twice."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents without the text, the token ids and the digests of ids and decoded text."""
    return bpe.encode(docs, bpe.default_vocabulary(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can express neither the learned classifier nor near duplicates; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    path = common.scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = common.stored(docs, path, f"{i}_{name}")
    return docs
