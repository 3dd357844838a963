"""A training corpus in five stages: toxicity, quality, near duplicates, mixing, tokens.

Every stage works on all that the one before kept. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, mixing, quality, registry, simhash, toxicity
from quillon.llm.common import fresh, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose chain says toxic with a probability of a half or more. Null and empty texts are judged too."""
    name = fresh(docs, "toxicity")
    marked = toxicity.scored(docs, toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), prefix=name)
    return marked.where(F.col(f"{name}.toxic") < toxicity.THRESHOLD).drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of a half or more."""
    name = fresh(docs, "quality")
    marked = quality.scored(docs, quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), score=name)
    return marked.where(F.col(name) >= 0.5).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id; of its repeated rows one.

    Near duplicates have a Jaccard of 0.8 or more over shingles of five words, or are joined by such texts.
    A group of null ids alone keeps one row too. Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources; a document that is taken twice stands there twice."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document of the mix. Its workers share executors with those of
    the earlier stages, so each keeps fewer words."""
    return bpe.digest(docs, registry.vocabulary(), cached=40_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic), ("quality", good_quality), ("near_duplicates", one_of_each), ("mix", mixed), ("tokens", tokens),
]

ORACLE_SQL = None  # the classifiers, fingerprints and merges have no SQL; the tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
