"""A training corpus from documents: five stages, each written as Parquet and read by the next.

A stage writes its own tables below a folder of the shared folder. The next stage deletes that folder when it begins,
unless the documents that it is given still read it; a stage that fails deletes its own.

Every stage keeps rows with null ids or texts where its step has nothing against them, and repeated rows each for itself;
extra columns pass through whatever their names, an empty table gives an empty result, and texts may have any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pitchflow.llm.common import Table, end_stages, read, shared_dir, stage
from pitchflow.llm.decontaminate import drop_contaminated
from pitchflow.llm.minhash import keep_one_of_each
from pitchflow.llm.queries import ORDER_KEY, stage_language_id, stage_mixing
from pitchflow.llm.token_output import write_training_order


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is sure enough; null and empty texts, and those without a letter, go. A null ``lang`` is filled in."""
    with stage(spark, docs):
        return stage_language_id(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, of equal ids one; null ids and texts without words stay."""
    with stage(spark, docs):
        return keep_one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them, each row judged by its own text; null and empty texts stay."""
    with stage(spark, docs):
        return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes, as often as it does; documents without words are never taken, null sources are a leaf of their own."""
    with stage(spark, docs):
        return stage_mixing(spark, docs, sf_dir)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each sequence in training order; documents without tokens are in none, null ids are listed as null."""
    with stage(spark, docs):
        return write_training_order(docs, key=ORDER_KEY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: The network's predictions and the tokenizer can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What stages hand on is deleted once it was read, and at once if one of them fails."""
    docs, written = read(spark, sf_dir, "documents"), []
    try:
        for name, step in STAGES[:-1]:
            written.append(Table(step(spark, docs, sf_dir), name, path=f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"))
            docs = written[-1].df
            if len(written) > 1:
                written.pop(0).drop()
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        for table in written:
            table.drop()
        raise
    finally:
        end_stages(spark)
