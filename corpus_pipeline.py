"""A corpus pipeline of five stages; each is a function of (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents (doc_id, text, lang, source, n_chars); other columns, whatever their
names, are left out at each stage.  Texts are read whole, however long.  An empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard, language, packing, substrings
from lectern.llm.shared import written
from lectern.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (a null or empty text has none), or in none of the languages learned from the labelled ones, go.

    Repeated rows are judged alike, a null doc_id or lang doesn't matter.  Without a labelled row no language is known, and all go.
    """
    return language.accepted(docs.select(*COLUMNS), language.fit(docs.where(~language.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one of the smallest doc_id stays.

    Repeated rows are one; rows of null doc_id, and of null or empty texts, stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS), 5, 80, 100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of 13 or more words that a document with a smaller doc_id has are cut out; a document of nothing else goes.

    A null or empty text stays as it is.  Rows of one doc_id keep what they share; a row of null doc_id loses nothing.
    """
    cut = substrings.dedup_substrings(docs.select(*COLUMNS), 13, with_text=True, carry=("lang", "source", "n_chars"))
    left = cut.where("n_removed = 0 OR n_removed < n_words")
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the question and the answer of a benchmark item go.

    Null and empty texts hold none; repeated rows, and rows of null doc_id, are judged each for itself.  Without items all stay.
    """
    return decontaminate.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences of 2048.

    A null or empty text is one piece, its end id; repeated rows are packed each for itself.  Pieces of one length may
    take each other's places.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 0, 2048)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fitted languages nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each one's rows being written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
