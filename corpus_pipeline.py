"""Corpus pipeline: language, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns them for what it keeps;
the last returns the pieces of sequences. ``run`` writes each stage's result as Parquet in the shared folder
and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import langid, neardup, packing, substrings, toxicity
from vigil.llm.runtime import drop_stored, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts among them), or that no learned language fits, go.

    Rows that repeat are judged alike; of an empty table nothing stays.
    """
    return langid.in_a_language(docs, COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, with or without a doc_id; a null or empty text has no word and stays."""
    return toxicity.clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words a shingle, similarity of 0.8 or more).

    It is the one with the smallest doc_id; null and empty texts, and rows without a doc_id, stay.
    """
    return neardup.first_of_each(docs, COLUMNS, shingle=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go; texts that lose a word are written anew, those left empty go.

    A null or empty text loses nothing and stays.
    """
    out = substrings.remove_repeated(docs, window=50, carry=("text", "lang", "source", "n_chars")).where("n_removed = 0 or kept <> ''")
    changed = F.col("n_removed") > 0
    text, size = F.when(changed, F.col("kept")).otherwise(F.col("text")), F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 ids; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, capacity=1024, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]
#: Learned models decide the first two stages, so SQL can't express the result; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
