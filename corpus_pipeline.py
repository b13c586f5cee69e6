"""Training-data pipeline over ``documents``: five operators, each on all that the one before kept.

1. language: documents whose language stays undetermined go.
2. near_copies: of each group of near copies, the document with the smallest id stays.
3. benchmark: documents that the benchmark contaminates go; others are left alone.
4. private_data: confirmed personal data is masked; ``n_chars`` follows the text.
5. mix: the words that the mix takes from each document.

All but the last return the columns of ``documents``.  Null or repeated ids, null
and empty texts, an empty table and columns with clashing names are handled as
the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetweave.llm import decontamination, langid, mixing, pii, shingles
from packetweave.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known."""
    return langid.with_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that pairs at a Jaccard similarity of 0.8 or more on five-word shingles connect."""
    return shingles.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which benchmark items hit less than a twentieth of the words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.uncontaminated(docs, items)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the mix; documents of which it takes nothing go."""
    return mixing.plan_mix(docs).filter("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("private_data", private_data), ("mix", mix)]

# Language scores, fingerprints and groups of copies are not for SQL; a test
# compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
