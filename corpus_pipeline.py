"""A corpus pipeline over ``documents``: quality, exact and near copies, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. Its
rows are written as Parquet and read again as the next stage's ``docs``. All but the last
stage return the columns of ``documents``, and pass further columns on, whatever their names. An empty table
gives an empty one in every stage, and texts of any length are worked on whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame

from copyfold.llm import bpe, minhash, mixing, quality_cnn, trie_dedup
from copyfold.llm.common import shared_folder, table
from copyfold.llm.queries import VOCABULARY


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it is fitted to labelled rows of ``docs``.

    Null texts score as empty ones, rows that repeat are judged alike, ids with both labels aren't learned from;
    without labels of both classes all documents score alike.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that with the smallest doc_id.

    A null text is an empty one, and empty texts are copies. A null id is the largest; of rows that share text and id, one stays, the
    same one in every run.
    """
    return trie_dedup.drop_copies(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more), that with the smallest doc_id.

    Texts without words are linked with nothing and stay. A null id is the largest; where all ids of a component are null, all its documents stay.
    """
    return minhash.drop_near_copies(docs)


def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document none, one or two times.

    A null source is one of its own, a null text has no words; of rows that share source, id and text as many are taken as fit.
    """
    return mixing.mixed_rows(docs)


def byte_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded bytes; a null text is an empty one, repeated rows each have theirs."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: The classifier can't be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on is kept in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
