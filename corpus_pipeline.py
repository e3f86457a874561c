"""A corpus pipeline from five of the operators: toxicity, near copies, repeated passages, source mix, packing.

Each stage takes all documents that its predecessor kept. Stages return the columns of
documents; the last returns the packed pieces with their token ids. run() applies them to the
documents table, with each stage's rows written as Parquet in the shared folder and read again.

Defined results: columns beyond those of documents are left out by run() and by every stage,
whatever their names; an empty table passes through all stages and gives no pieces; very long
texts are read whole by every stage. Each function's docstring states its results for nulls,
empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, mixing, packing, suffixes, toxicity
from lumenframe.llm.common import DOCUMENT_COLUMNS, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go. The model learns from the labels of the documents at hand.

    Null and empty texts have no evidence and stay, unless all labelled documents are toxic; without labels of both classes nothing
    goes (or all, if all labels are toxic); a score equal to the threshold goes; repeated rows go or stay together; null ids are never labelled.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return toxicity.drop_toxic(docs, model, toxicity.THRESHOLD).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 75 hundredths connect, the one with the least id stays.

    Texts that are null or without words, and rows with a null id, link with nothing and stay; rows that repeat an id stay or go together.
    """
    return jaccard.keep_one_of_each(docs).select(*DOCUMENT_COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id has are cut out; documents stay, if only as empty text. n_chars follows the text.

    Null texts stay null, with null n_chars; shorter texts stay whole; rows with equal ids don't cut each other; a null id counts as larger than all.
    """
    return suffixes.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get shares by the square roots of their sizes; documents are repeated or left out by their Poisson counts.

    A null source is a source of its own; rows with equal ids, or null ones, are repeated alike; texts don't matter.
    """
    return mixing.mix_sources(docs, "source", ["doc_id"], temperature=mixing.TEMPERATURE, seed=mixing.SEED).select(*DOCUMENT_COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences of 2048 tokens.

    Null and empty texts are one end token; each repetition of a row is packed for itself; of pieces of one length any may take a place.
    """
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the model, the tokenizer or the packing; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
