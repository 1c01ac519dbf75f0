"""From raw documents to a training mix, in five stages.

Each stage works on everything its predecessor kept, and its decisions take effect: rejected documents go, copies go
but one of each group, contaminated documents go, secrets are replaced in the text, and the mix keeps the documents
that it takes. All but the last stage return the columns of `documents`; the mix adds size, source_size, target,
taken and finish, and is sorted by finish time. Between stages the documents are written as Parquet in the shared
folder and read again.

Nulls and odd input: documents whose text is null or empty have too few words and go in the first stage; a null
language or source is a group like any other; null ids are fine. Texts of any length are read whole. Of repeated rows
the second stage keeps one. No documents, or none that pass, give an empty mix; an empty benchmark rejects nothing.
Other columns pass through all stages, whatever their names, but for those named like the mix's, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tractloom.llm.common import settle, table
from tractloom.llm.decontaminate import clean_documents
from tractloom.llm.mixing import mixed_documents
from tractloom.llm.quality import kept_documents
from tractloom.llm.secrets import redacted_documents
from tractloom.llm.simhash import distinct_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints, the one with the smallest id."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in them replaced by their kind."""
    return redacted_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with what it takes of each, in its order."""
    return mixed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
]

#: None: DuckDB has no XXH64 and no components, which the second stage needs; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
