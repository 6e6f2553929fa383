"""A corpus made ready for training: STAGES over `documents`, each written as Parquet and read again as the next one's input.

1. Documents whose language can't be told go (null text, no letter).
2. Of documents with near-equal SimHash fingerprints the one with the smallest doc_id stays.
3. Windows of 35 words that occur more than once are taken out of the texts; documents that lose all words go.
4. Documents that hold a window of a benchmark item go.
5. The rest is tokenized and packed into sequences: one row for each piece.

All stages take a row for a document by its doc_id and its whole text together, so null or repeated doc_ids with different texts are different documents.  All but
the last return the columns they were given, whatever further ones there are and however they are named; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import decontaminate, langid, packing, simhash, substring
from wattline.llm.base import staged, table, tuned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without null and letterless texts and those that the network can't tell.  Rows are judged one by one: repeated rows stay, very long texts are read whole."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-equal texts: the smallest doc_id, null before all; of one doc_id the text with the smallest hash; of equal rows the least by all columns.
    Null and empty texts have one fingerprint and are near each other."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows.  Rows equal in doc_id and text are no copies of each other; null, empty and short texts have no windows and stay as they are."""
    return substring.strip(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark window; null and empty texts hold none.  Rows that only share the doc_id of such a document stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; null and empty texts are one token, repeated rows are packed each."""
    return packing.pack(docs)


def _stage(fn):
    return lambda spark, docs, sf_dir: fn(tuned(spark), docs, sf_dir)


STAGES = [(fn.__name__, _stage(fn)) for fn in (language, near_duplicates, repeated_passages, benchmark_leaks, packed)]

#: Neither the trained network nor the tokenizer can be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
