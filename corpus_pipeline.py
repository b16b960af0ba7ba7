"""The training-corpus pipeline over `documents`: identify the language, drop toxic documents, keep one of
each group of near copies, redact personal data, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents, and carry any
further columns along, whatever their names. Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import jaccard, langid, packing, pii, toxicity
from loomspark.llm._common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null or empty text, text without a letter, a tie, a margin up to the learned one.

    Rows are judged one by one, so repeated rows stay or go together.
    """
    return langid.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic (a score of 0.7 or more) go. Null text has no terms and a score of its own.

    Rows are judged one by one, so repeated rows stay or go together; a document labelled twice teaches as toxic if one label says so.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    It is that of the least doc_id; of several rows with that id, the one whose text sorts first (null last), then the one
    whose other columns do. Null or blank texts are in no group. Rows without doc_id stay.
    """
    return jaccard.keep_first(docs, words=5, num=80, den=100)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind; every document stays, null text as null, repeated rows alike.

    Overlapping spans become one, of the kind that starts first (of equal starts, the kind listed first).
    """
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document in a sequence. Null text is its end token alone; repeated rows and ids are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can't express the classifiers; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
