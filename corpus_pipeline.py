"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each
stage's rows as Parquet in the shared folder and gives them to the next one.  All but the last return the
columns of ``documents``; n_chars follows the text.

Nulls, empty texts, repeated rows and extra columns are treated as each operator says; an empty table goes
through all stages.  The stages work on the columns of ``documents`` and drop others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trivalent.llm import neardup, packing, pii, quality, substring
from trivalent.llm.queries import tokenizer
from trivalent.llm.scratch import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay, without the lines that fail."""
    return quality.clean_documents(docs.select(COLUMNS), length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.keep_one(docs.select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document has go; a document of which nothing is left stays, empty."""
    return substring.without_repeats(docs.select(COLUMNS), length_col="n_chars")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs.select(COLUMNS), length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The stages of personal data and of packing can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
