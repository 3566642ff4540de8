"""Training-data pipeline over ``documents``: each stage applies one operator of ``marlstone.llm``.

A stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of ``documents``, whatever they are and whatever
their names. In every stage a null text is as an empty one, repeated rows are judged each for itself (of
near duplicates, all rows with the kept doc_id stay), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import common, decontaminate, near_duplicates, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts do not. A null doc_id is judged by its text."""
    return quality.filter_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near duplicates of similarity 0.80 or more; ties
    can't be, ids being distinct. Documents without words and with a null doc_id all stay."""
    return near_duplicates.deduplicate(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; null or blank items match nothing, and a null doc_id is judged by its text."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; a null text stays null."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 4096 tokens; an empty or null text is one piece, its end
    sign, and a null doc_id is packed like any other."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Tokenisation and edit matching have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie in the shared folder as Parquet."""
    work = common.Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"stage-{k}")
    return docs
