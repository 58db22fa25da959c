"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. The result of each is written as Parquet in the shared scratch folder and
read again as the next one's docs.

Of every stage: an empty table gives an empty table; columns that a stage does not use may be null
and may have any name; very long texts are taken as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm.common import materialise, read, scratch_dir
from tidegraph.llm.op3_tokens import token_digest
from tidegraph.llm.op4_mix import mixed
from tidegraph.llm.op5_jaccard import one_of_each
from tidegraph.llm.op7_decontaminate import decontaminate
from tidegraph.llm.op8_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts are too short; repeated rows are judged one by one."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id, a null one before others.

    Null texts and those without words are no copies of each other, but rows alike in id and text are one
    document: of these the first as JSON stays.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages do not contaminate. Null texts and items have no words; repeated rows share their judgement."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as it has copies.

    A null source is one source, the last; documents without words are in no mix; rows alike in id and text get
    the same number of copies each.
    """
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files.

    A null doc_id comes first, a null text is the end id alone, repeated rows are documents of their own.
    """
    return token_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token files", token_files),
]

#: SQL expresses neither the join's token choice nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to documents."""
    where = scratch_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}", where)
    return docs
