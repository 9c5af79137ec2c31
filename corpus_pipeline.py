"""Corpus preparation: five stages from raw documents to packed training sequences.

Each stage works on all its predecessor kept. A stage's result is written as Parquet in the
shared folder and read again as the next one's documents.

Defined results, of every stage: a null id is a document like any other and stays null; a null text counts as
empty, and no stage fills it; rows with equal id and text are one document for the dedup stages (one stays) and documents of
their own for the others; very long texts are read whole; further columns go through the first four stages as they are,
whatever their names; an empty table gives an empty result. The last stage returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import exact_dedup, mixing, packing, quality, simhash
from clausegrid.llm.common import release, save, table


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix takes it, in training order."""
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row for each piece of a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good_texts),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier's network and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
