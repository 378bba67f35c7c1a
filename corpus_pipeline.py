"""From raw documents to token ids: five stages, each on all that the one before it kept.

The toxic go, one of each group of near-duplicates stays, the contaminated go, secrets are masked, and the rest is
encoded. Each stage's result is written as a table in the shared folder and read again.

Cases that all stages have in common: a null text counts as empty and its row goes on; repeated rows are separate rows,
but for near-duplicates, of which one stays; columns of any name go on untouched; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, decontaminate, secrets, simhash, toxicity
from heddle.llm.base import written
from heddle.llm.queries import word_bpe_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; all have one score if labels of either class are missing."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group that five-word shingles of similarity 0.8 or more connect."""
    return simhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of an item of benchmark occurs."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked, n_chars counted anew (null for a null text)."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    return bpe.encode_documents(docs, word_bpe_path(), full=True, digests=True, decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("encoding", encode),
]

#: SQL can't express the first stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
