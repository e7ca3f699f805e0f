"""The corpus pipeline: stages over `documents`, each reading what the one before it kept.

All stages keep the columns they get (the last one adds three), whatever their names; null texts count as empty and
stay null; repeated rows are judged alike; empty tables give empty results; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, decontamination, secrets, simhash, toxicity
from attesta.llm.common import small_batches, table, written
from attesta.llm.queries import tokenizer_path


def detoxified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; without labels of both kinds all stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id, once if its row is repeated. Texts without words are one group; rows without a doc_id stay."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages by the contamination rule go; an empty benchmark removes none."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are masked; all documents stay."""
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (of a null text none), their number, and whether they decode to the text."""
    small_batches(spark)
    return bpe.checked(docs, tokenizer_path()).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", detoxified),
    ("near_duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("tokens", tokenized),
]

#: Not expressible in SQL (learned scores, fingerprints, tokenizers).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; between stages the rows are written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
