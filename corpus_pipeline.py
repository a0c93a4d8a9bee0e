"""A corpus from documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept; all but the last return the columns of documents.

Defined results: a null text counts as empty and stays until packing, where it is one end id. Rows without a doc_id are
documents of their own in every stage. Of rows equal in doc_id and text near-dedup keeps one; of rows that share only a
doc_id all stay or none. An empty table gives an empty one. Columns beyond those of documents travel along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ohmgraph.llm import line_dedup, mixing, packing, similarity, toxicity
from ohmgraph.llm.common import keep_only, made, table, written

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), least=0.5)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go."""
    return line_dedup.without_common_lines(docs, min_docs=10, min_chars=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles, the document with the smallest id stays."""
    return similarity.without_near_copies(docs, n=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The uses of documents in a mix of sources by weight."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, limit=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The first and the last stage learn and tokenise; SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        keep_only(since, docs)  # what the stage and the one before it wrote goes
    return STAGES[-1][1](spark, docs, sf_dir)
