"""A training corpus from documents: good ones, in a known language, without frequent lines or near copies, packed.

Each stage works on all that its predecessor kept. Null texts count as empty: the quality classifier scores them like any
other, language ID rejects them (they are `und`), the lines of those that come later are one empty line, they are copies of
each other, and they pack as the end id alone. Rows with a null doc_id pass every stage as rows of their own; rows that repeat
a doc_id stay together until the near-copy stage, which keeps one of each text. Null lang or source is never looked at but for learning.
Other columns pass through, whatever their names. An empty table gives an empty one, and so do documents of which none has a
language to learn from. Equal scores are equal decisions, and of equal texts the smallest doc_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, packing, quality, simhash
from tessera.llm.common import dropped, read, scratch, written

#: The corpus comes at once, so its lines come in few batches; how many there are changes no result.
LINE_BATCHES = 3
#: Language ID rejects `und`, and what it is less sure of than this.
MIN_LANGUAGE_SCORE = 0.2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, predicts to be good."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang stays as it came."""
    model = language.fit(docs.where(~language.held_out()))
    return language.keep_known(docs, model, MIN_LANGUAGE_SCORE)


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have; n_chars follows the text."""
    kept = line_dedup.without_frequent_lines(docs, n_batches=LINE_BATCHES, fanout=2)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return kept.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in windows."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("lines", without_frequent_lines),
    ("near_copies", one_of_near_copies),
    ("packing", packed),
]

#: SQL has neither the classifiers nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:  # of a stage, only its output stays, until the next one has read it
            docs, path = written(stage(spark, docs, sf_dir))
            keep.append(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
