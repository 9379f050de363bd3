"""A corpus pipeline of the training-data operators, each stage written and read again.

Every stage reads whole texts of any length, gives an empty result for an empty table, and carries columns it does not know along. A column of a name that
a stage's operator makes (lang_pred and score; n_lines and n_removed; copy and n_copies) comes out with the operator's values, and shuffle_key goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontam, langid, linededup, mixing, simhash
from recollect.llm.common import table
from recollect.session import Cut

#: Language ID rejects texts without a language and those whose best language is no likelier than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.

    Null texts and texts without a letter have none and go; so do all where no row has both text and lang to learn from. Rows of null doc_id or
    lang are judged by their text like any other; repeated rows all stay or all go; of equally likely languages the first by name counts.
    """
    found = langid.identify(docs, docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated and similar lines taken out; those of which nothing is left go.

    Null and blank texts lose no line and stay. Of linked lines that of the smallest (doc_id, text hash, place) stays, null ids last, so there are no
    ties; rows that repeat doc_id and text are one document and get the same text. n_chars is counted anew.
    """
    found = linededup.dedup_lines(docs)
    found = found.where(~((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group.

    Null and empty texts share fingerprint zero and are a group like any other. The smallest doc_id of a group stays, null ids last, ties by the
    text's hash; rows that repeat doc_id and text count once.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null and empty texts share none and stay, as all do where the benchmark is empty; null items hold no passage; repeated
    rows all stay or all go.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' shares, in a global random order.

    Null source is a source of its own; texts, null ones too, are carried along; a null doc_id is drawn for by its text; repeated rows get
    the same number of copies each. Adds copy and n_copies.
    """
    return mixing.mix(docs).drop("shuffle_key")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL expresses neither the classifier nor MinHash; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = Cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs
