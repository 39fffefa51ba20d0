"""From raw documents to packed training sequences, in five stages of the operators in tracelake.llm.

Each stage reads all that its predecessor kept, and its result is written as Parquet before the next one
reads it.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.common import materialize, release, scratch
from tracelake.llm.exact_dedup import drop_exact_copies
from tracelake.llm.jaccard_join import one_of_each_group
from tracelake.llm.language_id import known_language
from tracelake.llm.mixing import mixed_documents
from tracelake.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is ambiguous, go; null and empty texts have no letter."""
    return known_language(docs)


def deduplicate_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a row given twice stays once."""
    return drop_exact_copies(docs)


def deduplicate_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 of their five-word shingles, the smallest doc_id stays; a null doc_id links nothing."""
    return one_of_each_group(docs, k=5, num=4, den=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows with equal doc_id and text are taken together."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence; each row by itself, whatever its doc_id."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", deduplicate_exact),
    ("jaccard_join", deduplicate_near),
    ("mix_sources", mix),
    ("pack", pack_sequences),
]

#: The stages learn a classifier and run a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; of what the stages wrote, only the last one's input is left."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
