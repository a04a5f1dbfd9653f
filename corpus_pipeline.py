"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import exact_dedup, mixing, near_dedup, pieces, quality, tables
from gaugeline.scratch import materialise
from gaugeline.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; learnt from the labels outside its test fold.

    Null and empty texts are voted on as any other; very long ones are read whole; repeated
    rows share their fate. Without labels all stay. An empty table gives no rows, and columns
    stay as they are, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    voters = quality.fit(docs, labels, quality.held_in(F.col("doc_id")))
    name = tables.fresh(docs, "quality")
    scored = quality.score(docs, voters, name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id; null equals empty.

    A null id goes before no other, and of repeated rows one stays. Very long texts are compared
    whole, an empty table gives no rows, and columns stay as they are, whatever their names.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Texts without words, null ones among them, are of one class. A null id stays only if alone,
    and of repeated rows one stays. Very long texts are compared whole, an empty table gives no
    rows, and columns stay as they are, whatever their names.
    """
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source; a document that the mix takes twice stands twice.

    A null source is a source, a text without words has size 0, repeated rows are documents of
    their own. An empty table gives no rows, and columns stay as they are, whatever their names.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces in `ids`, which replaces a column of that name.

    Null and empty texts have no pieces; very long ones are encoded whole; repeated rows are encoded
    alike. An empty table gives no rows, and other columns stay as they are.
    """
    return pieces.encode(docs, name="ids")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: A classifier, sketches and Viterbi are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
