"""A corpus pipeline: toxicity, language, near-duplicates, benchmark leaks, then packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, language_id, ngram_join, packing, toxicity
from tickloom.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier chain does not call toxic. Null and empty texts are judged by their empty features and
    stay unless such texts are toxic; without labels all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts whose language is recognised with a probability of a half or more, learnt from all rows with a
    language. Null and empty texts and texts without a letter go; so do all when no row has a language."""
    return language_id.identified(docs, F.lit(True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group linked by five-word shingles of similarity 0.8 or more. Rows
    with a null id, and texts without words, all stay; so do repeated rows of the least id."""
    return ngram_join.one_of_each_group(docs, words=5, percent=80)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that hold no benchmark window of ten words (or a whole shorter item). Null and empty texts stay."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens; null and empty texts are one token, copies are packed each."""
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("packing", pack_sequences),
]

#: The learnt stages and the packing have no SQL; a test holds the whole run against rows planted for each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole document table, each written as Parquet and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
