"""A corpus pipeline of five stages; each reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._spark import cut
from quarry.llm.decontaminate import decontaminate
from quarry.llm.jaccard import one_of_each_group
from quarry.llm.packing import best_fit_packing
from quarry.llm.quality_rules import quality_rules
from quarry.llm.queries import table, tokenizer_path
from quarry.llm.substring_dedup import substring_dedup

#: Some stages need what SQL cannot express; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality_rules(docs, table(spark, sf_dir, "labels"), rest=True)
    return judged.where("kept").select("rest.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id."""
    return one_of_each_group(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; n_chars follows the text."""
    found = substring_dedup(docs, rest=True)
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return found.select(*(values.get(c, F.col(f"rest.{c}")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_group),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
