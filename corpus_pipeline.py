"""A corpus from raw documents to packed sequences; each stage works on all that the one before it kept.

Defined results: a null or empty text, or one without a letter, goes in the first stage; of equal texts the largest doc_id
stays, of near copies the smallest; rows equal in doc_id and text are one; columns that aren't read are carried along, whatever
their names; texts may be of any length; without a labelled document nothing can be told, so nothing is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoal.llm import exact_dedup, jaccard, language, packing, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those whose language can't be told (no letters, a posterior under a half, or letters that
    are far less likely than the language's own words) go."""
    return language.accept(docs, language.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the document with the smallest doc_id stays.

    Fingerprints within two bits are found by the grid range-join of ``simhash``, the pairs out of its reach by minima."""
    return jaccard.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048; one row per piece."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

#: Models, fingerprints and tokenizers can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
