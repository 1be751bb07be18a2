"""The corpus pipeline: quality rules, quality classifier, near duplicates, pseudonyms, packing.

Every stage but the last takes and returns the columns of documents; each works on all that the one before kept.
Null texts, empty tables, repeated rows and further columns are handled as the operators' docstrings say; further columns of
documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import packing, pii, quality_classifier, quality_rules, simhash
from starloom.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules or the model reject go."""
    return quality_rules.kept(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the combined views reject go."""
    return quality_classifier.kept(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on five words and bits that a similarity of 0.8 leaves alike: of each group the smallest doc_id stays."""
    return simhash.representatives(docs.select(*COLUMNS), words=5)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the texts with pseudonyms; n_chars follows."""
    return pii.pseudonymise(docs.select(*COLUMNS), pii.key_of(spark)).select("doc_id", "text", "lang", "source", F.when(F.col("n_pii") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("simhash_near_duplicates", keep_one_of_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: Models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
