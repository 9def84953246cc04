"""The corpus pipeline: documents to packed training sequences, by five of the training-data operators.

Each stage is written as Parquet in the shared folder and read again before the next. All but the
last return the columns of ``documents``, whatever other columns (also of clashing names) their input
has. Every stage takes nulls in any column, very long texts, which it treats whole, ties, repeated rows
and empty tables, of which it makes an empty table; what it does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import table, written
from emberlog.llm.decontaminate import drop_leaks
from emberlog.llm.neardup import drop_near_duplicates
from emberlog.llm.packing import pack
from emberlog.llm.quality import clean_lines
from emberlog.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, and documents that lose too much of their text. Null and empty texts
    and texts of white space go. Nulls in other columns stay. Repeated rows are judged alike: there
    are no ties."""
    return clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (null is the
    largest), of equal ones that with the least hash of its row, and one of rows that are the same.
    Null and empty texts are no copies of each other and stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go. Null and empty texts hold none and stay, as do
    rows without a doc_id that hold none; rows that are the same go or stay together: there are no
    ties."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials in texts are replaced; all documents stay, null and empty texts as they are. Repeated
    rows are changed alike; a score equal to the threshold is a finding."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches. Null and empty texts have none; documents
    of more tokens than a sequence holds are cut into pieces; null doc_ids stay null; repeated rows
    are sequences each, in an order by doc_id, row and piece."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL has neither tokenisers nor trained networks; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
