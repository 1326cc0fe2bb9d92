"""Corpus pipeline: language ID, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
``documents``; the last returns the pieces of packed sequences. Nulls in any column, empty and very long
texts, repeated rows, empty tables and extra columns are handled as the operators' docstrings say; extra columns of ``documents``
go with the first stage. A stage's table is deleted once the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import delete, new_path, read_table, stored
from corpusloom.llm.decontaminate import decontaminate
from corpusloom.llm.language_id import keep_known
from corpusloom.llm.line_dedup import line_dedup
from corpusloom.llm.near_dedup import keep_one
from corpusloom.llm.packing import default_tokenizer, digest, pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go."""
    return as_documents(keep_known(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; ``n_chars`` follows the text. All documents stay."""
    return as_documents(line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return as_documents(keep_one(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return as_documents(decontaminate(docs, read_table(spark, sf_dir, "benchmark"), "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences with the corpus' own mixture of sources."""
    return digest(pack(docs, default_tokenizer()))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]

#: Neither the language models, nor components of similar documents, nor token ids can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", path=path)
        if before:
            delete(spark, before)
        before = path
    return docs
