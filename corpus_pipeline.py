"""A corpus made ready for training: quality, near duplicates, repeats, personal data, packing.

Each stage takes what the one before it kept and works on all of it; what a stage
decides shows in the rows and texts that it passes on. Between stages the documents
are a table in the shared folder, so a lost executor costs no earlier stage. All
stages but the last return the columns that they are given, whatever else these
hold; each gives an empty table for an empty one; a text is worked on whole however long
it is; rows with equal or null ids are documents of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.sources.shared import written

#: The key of the pseudonyms; a corpus of your own takes a secret one.
KEY = b"a key for the pipeline alone"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject (a score of 0.5 or more).

    A null or empty text is scored by its statistics like any other; repeated rows
    have equal scores and stay or go together; documents with a null id are scored and
    never learnt from; without usable labels every score is 0.5, so all stay.
    """
    from kilnwork.llm import quality_classifier

    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, a similarity of 0.8): the one with the least id.

    A null id is the least; of rows with equal ids the text's hash decides, then the
    least hash of the other columns; a repeated row stays once. Texts without words
    (null, empty) all stay, each distinct row once. A text of any length is compared
    whole; an empty table gives an empty one.
    """
    from kilnwork.llm import ngram_join

    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that have come before, by id and place; characters broken at a cut go too.

    A null text becomes empty; a null id comes before all others; repeated rows aren't
    earlier than each other and get the same text. All rows stay.
    """
    from kilnwork.llm import suffix_dedup

    return _counted(suffix_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data. A null text stays null, an empty one empty; equal values get equal pseudonyms everywhere; all rows stay."""
    from kilnwork.llm import pii

    return _counted(pii.pseudonymised(docs, KEY, keep_columns=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row a piece. A null or empty text is the end's id alone; a null id stays null; repeated rows are packed each by itself."""
    import public_tokenizers

    from kilnwork.llm import packing

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packed)]

#: The stages can't be said in SQL (a learnt classifier, keyed pseudonyms, a tokenizer); tests hold each against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
