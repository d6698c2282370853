"""A training corpus from documents: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, personal data is replaced, sources are mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm.common import materialize, table
from locusframe.llm.decontaminate import drop_leaks
from locusframe.llm.mixing import mix_sources
from locusframe.llm.ordermin import keep_one_of_each
from locusframe.llm.pii import redact
from locusframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5 (llm.toxicity); null and empty texts, ties and repeated rows stay or go by their score; all columns stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id, null first (llm.ordermin).

    Null and empty texts are one class; of repeated rows one stays; all columns stay.
    """
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item (llm.decontaminate); null and empty texts and repeated rows stay; all columns stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced (llm.pii) and n_chars, if there is such a column, counted anew (null for null)."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all their columns, and what the mix takes of each (llm.mixing).

    size: words; source_size and target: words of its source and of the mix's share of that; taken: words of the document that the mix
    takes, repeats counted, so taken / size is how often it is read (0: never); shard, shard_blocks, shard_quota: where its blocks are. Null texts
    have no words; null sources are one source; repeated rows are taken each; a column of one of these names is replaced.
    """
    return mix_sources(docs, whole=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: Alignment, BM25 and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
