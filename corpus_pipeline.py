"""A training corpus out of documents, in five stages.

Each stage reads all that its predecessor kept, and its result is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doctide.llm.common import Scratch, table
from doctide.llm.mixing import mix_copies
from doctide.llm.packing import packed
from doctide.llm.quality import resample
from doctide.llm.repeats import strip_repeats
from doctide.llm.simhash import drop_near_duplicates, similar_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones draws; the others go.

    Null texts and texts without words go; equal rows stay or go together.  Without good labels every text with words stays.
    """
    return resample(docs, table(spark, sf_dir, "labels"), Scratch(spark))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles: that of the smallest doc_id.

    Of repeated rows one stays.  Texts without words, null ones included, are one group; rows without doc_id all stay.
    """
    return drop_near_duplicates(docs, Scratch(spark), similar_duplicates)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the strings of 400 bytes and the passages of over 50 words that start elsewhere too.

    Null and empty texts stay as they are; repeated rows and equal texts lose what they share.
    """
    return strip_repeats(docs, Scratch(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target share takes them.

    A null source is a source of its own, the last; a text without words has size 0.
    """
    return mix_copies(docs, Scratch(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document.

    Null and empty texts are one empty piece; repeated rows and equal texts are one cluster and never share a bin.
    """
    return packed(docs, Scratch(spark))


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("best-fit packing", best_fit_packing),
]
#: SQL can express neither the classifier nor the fingerprints; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
