"""documents -> packed training sequences, in five stages of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language_id, near_dedup, packing, source_mixing
from tidemark.llm.common import documents, materialise


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; models and bounds come from the labelled documents themselves."""
    return language_id.accept(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles stays."""
    return near_dedup.drop_near_duplicates(docs, similarity=0.8, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources more often, up to twice: shares near to equal ones."""
    return source_mixing.mix(docs, target_entropy=0.999, max_repetition=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids in which the mixture's proportions hold; copies of a document lie apart."""
    return packing.pack(docs, window=2048, copies=True)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing, learned models and prefix sums have no SQL twin; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(result, name.replace(" ", "-"))
    return result
