"""A corpus from documents to packed sequences: five stages, each over all that its
predecessor kept.

Every stage takes documents (doc_id, text, and any other columns, whatever their names) and
all but the last return all of these columns. Null and empty texts, null ids, repeated rows
and an empty table have a defined result in each, which its docstring states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import shared
from attestry.llm.decontam import decontaminate
from attestry.llm.jaccard import near_dedup
from attestry.llm.linededup import line_dedup
from attestry.llm.packing import pack
from attestry.llm.quality import quality_filter

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier keeps. A null text is scored as an
    empty one; equal texts stay or go together; without labels or documents all stay."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines that stand earlier in the corpus; a
    whole number n_chars follows the text. Null and empty texts stay; a null id comes last;
    rows equal in id and text are cut alike; what is left with nothing but blanks goes."""
    out = line_dedup(docs, whole=True)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind in ("int", "bigint") else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least (id, hash of text), a
    null id first. Null texts and texts without a word stay; rows equal in id and text stay
    or go together."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts stay; repeated
    rows stay or go together."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins under three capacities. Null and empty texts are in none; repeated rows have
    pieces of their own; a null id is kept."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: No stage but exact comparison is SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result but the last a table in the shared folder,
    where what a stage no longer needs is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(shared.MADE)
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name)
        shared.drop(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
