"""From raw documents to packed sequences, in stages that each read what the one before has written.

All stages take rows as they are: columns besides doc_id, text, lang and n_chars go through untouched, whatever their names (names that a stage needs for itself are chosen so that none clashes), texts of any length are handled whole, ties go to the lesser doc_id, and an empty table stays one. What each stage does with nulls, empty texts and repeated rows stands with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import langid, packing, passages, secrets, setjoin
from barwright.llm.common import fresh, stored, table

#: Less than this share of a profile's places in common with the nearest language is no language.
LEAST_LANGUAGE_SCORE = 0.2


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from their own lang column; the others go. A null text, or one without a letter, has no language and goes. Rows that repeat are judged alike."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(langid.held_out_fold(5, 0), F.lit(False)))
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    judged = langid.predicted(docs, langid.fit_profiles(train), lang_name=lang, score_name=score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Null and empty texts and rows without an id are classes of their own and stay. Of rows that repeat an id the first by text stays."""
    return setjoin.one_of_each(docs)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document with the least id that holds them. Null texts stay null; rows without an id, and texts of fewer words, stay as they are."""
    return passages.without_repeats(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to their kinds. Every row stays; a null text stays null."""
    return secrets.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 2048 tokens. Null and empty texts are a single end id; rows that repeat are packed as often as they occur; a longer text is cut."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", passages_once),
    ("secret_scan", masked_secrets),
    ("best_fit_packing", sequences),
]

#: Similarity joins, passage alignment and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
