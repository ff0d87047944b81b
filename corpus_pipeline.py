"""A training corpus from documents: toxicity, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import shared_folder
from docloom.llm.near_copies import keep_first
from docloom.llm.packing import pack_documents
from docloom.llm.pii import pseudonymize
from docloom.llm.substring_dedup import remove_repeats
from docloom.llm.toxicity import fit_toxicity, score_toxicity

#: No stage's result can be stated in SQL as a whole: the first is a fitted model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the model does not call toxic. It learns from the labels of all its input."""
    chain = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=None)
    return score_toxicity(docs, chain).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first row of each group of near copies (five-word shingles, Jaccard 0.8 or more), by id
    with null ids last; rows without words are in no group and all stay. SimHash with ball hashing proposes
    copies, MinHash bands those beyond its radius; see near_copy_groups and keep_first."""
    return keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that a document with a smaller id has; n_chars follows the text."""
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of the same format; n_chars follows the text."""
    return pseudonymize(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens; see pack_documents for the columns."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("personal_data", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
