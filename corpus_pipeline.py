"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` applies them in order to the table documents, each
over the Parquet its predecessor wrote in the shared checkpoint folder. All
stages but the last return the columns of documents.

SQL cannot express language models, alignments or the network, so there is no
oracle; tests hold the pipeline against a plain version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsift.llm import best_fit, kn_langid, order_minhash, position_index, secret_cnn
from logsift.llm.common import read
from logsift.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those the models reject go."""
    return kn_langid.keep_recognised(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return order_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in 5 % of their words or more go."""
    return position_index.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows where a text changed."""
    return secret_cnn.redact(docs, secret_cnn.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2,048 tokens."""
    return best_fit.op6(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("secrets", secrets), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
