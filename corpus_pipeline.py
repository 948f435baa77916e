"""From raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir); the result of each is written as Parquet and read
again as the documents of the next.  All but the last return the columns of the documents.  Empty
tables, null ids, texts and sources, repeated rows and further columns pass through every stage as
its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, near_dup, packing, repeats
from tidemark.llm.shared import Work, closing, read

#: Bytes of a string that counts as a repeated passage: less than 50 short words.
PASSAGE_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or between two, go; learned from the documents' own languages."""
    return language.identify_rows(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) the least id stays."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in several places are taken out of the texts; every document stays."""
    out = repeats.remove_repeats(docs, length=PASSAGE_BYTES)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes its words, whole or, where a source would miss its target, cut."""
    out = mixing.mix_rows(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of every piece; no bin has two documents of a source or of one text."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express training, sketches or packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with closing():  # of a stage only its result stays
            docs = work.keep(stage(spark, docs, sf_dir), name)
    return work.keep(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
