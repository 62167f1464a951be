"""From raw documents to packed sequences: language identification, near-duplicates, personal data, mixing, packing.

Every stage works on all that the one before kept and is written to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import stage
from tallyspark.llm.langid import keep_identified
from tallyspark.llm.mixing import mix_sources, take_copies
from tallyspark.llm.neardup import drop_near_duplicates
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.pii import redact_personal_data

#: No source is repeated more often than this to even out the sources; none is cut.
REPEAT_LIMIT = 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier recognises; the rest goes."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share four fifths of their word shingles, the one with the smallest id."""
    return drop_near_duplicates(docs, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by placeholders."""
    return redact_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, each at least once."""
    return take_copies(mix_sources(docs, repeat_limit=REPEAT_LIMIT))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their token ids."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing),
          ("packing", packing)]

#: The tokenizer, MinHash and the trained models are outside SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
