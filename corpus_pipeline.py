"""From raw documents to a training mix: five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, langid, mixing, near_copies, substring_dedup
from strata.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected below this pooled probability of its likeliest language.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents without a letter, or in no language that was learned, go."""
    return langid.identify(docs).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of documents alike in 0.8 of their five-word shingles, in chains, the one with the smallest id stays."""
    return near_copies.near_copies(docs).where("is_first").select(*docs.columns)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: words of passages that occur elsewhere go; other texts stay as they are."""
    out = substring_dedup.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with a verified benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: how many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_removal),
    ("decontaminate", decontamination),
    ("source_mix", source_mix),
]

#: A trained network, hashes and draws decide; SQL has no words for them. tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else materialize(out)
    return docs
