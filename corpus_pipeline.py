"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, and its decisions take effect: the
first three drop rows, the fourth masks secrets in the texts, the last packs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import langid, neardup, packing, secrets, toxicity
from sylva.llm.common import table
from sylva.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language."""
    return langid.keep_known(docs, langid.learn(langid.learn_rows(docs)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, toxicity.learn_rows(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars counts the masked text, where the table has it."""
    out = secrets.redact(secrets.find_secrets(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("packing", packed),
]

#: Learned models, signatures and packing plans are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
