"""The training-data pipeline: five stages over documents, each reading what the one before wrote.

A stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents:
toxicity drops what the classifier rejects, the Jaccard join keeps the first document of each group,
suffix-array dedup cuts repeated passages out of the texts, decontamination drops documents that hold
benchmark passages, and mixing returns how many words of each document the target weights take.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaloom.llm.common import scratch, stored, table
from lexaloom.llm.decontam import decontaminated
from lexaloom.llm.jaccard import one_of_each
from lexaloom.llm.mixing import mix
from lexaloom.llm.suffix import deduplicated
from lexaloom.llm.toxicity import THRESHOLD, scored, train


def own_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over columns with names of their own, so that none of docs' can clash with an operator's; n_chars stays if there."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"_in{k}" for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run


@own_names
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose score is below the threshold; null and empty texts score as texts without features, repeated rows are judged each."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=tuple(docs.columns)).where(F.col("score") < THRESHOLD).drop("score")


@own_names
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones; texts without words stay."""
    return one_of_each(docs)


@own_names
def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without strings of 200 bytes that also start elsewhere; a cut character goes whole."""
    kept = deduplicated(docs, tuple(c for c in docs.columns if c not in ("text", "n_chars")), with_text=True)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


@own_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that overlap with no benchmark item; null, empty and short texts overlap with none, repeated rows go or stay together."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row; null and wordless texts have size 0, repeated rows are separate texts, an empty table gives no rows."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard),
    ("suffix_array_dedup", suffix_array),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing),
]

#: No SQL: the classifier and the seeded decontamination can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage stores on its way goes when its result is written
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
