"""The documents on their way to training: toxicity, near copies, secrets, mixture, packing.

Each stage takes the stored documents that the one before kept and returns a frame to be stored in turn.  Nulls in any
column, empty texts, repeated rows, rows without an id and columns of any name go through every stage; an empty
table gives an empty one.  Tables that a stage wrote for itself are deleted when the next stage begins, as its result is
stored by then.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.common import drop_tables, read_documents, read_table, table, tables_into
from larkspur.llm.jaccard import keep_one
from larkspur.llm.mixing import mix
from larkspur.llm.packing import pack
from larkspur.llm.secrets import redact
from larkspur.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the limit stay; the model learns from the labels of documents that are not held out.

    Null and empty texts stay or go as a text without words does; without labels no document scores above 0 and all stay.
    """
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest doc_id stays; a null id gives way to any other.

    Null and empty texts have no shingles and stay; of rows alike in every column one stays, if it has words.
    """
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in it are masked.  Null and empty texts hold none."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; a null source is one, null and empty texts have size 0."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 ids, neighbours on the curve together; a null text is an empty one."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _in_turn(stages: list[tuple[str, Stage]]) -> list[tuple[str, Stage]]:
    """Each stage deletes the tables that the stage before it wrote for itself; those of the last one stay."""
    own: list[list[str]] = [[] for _ in stages]

    def wrapped(i: int, stage: Stage) -> Stage:
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if i:
                drop_tables(spark, own[i - 1])
            with tables_into(own[i] if i < len(stages) - 1 else []):
                return stage(spark, docs, sf_dir)

        run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
        return run_stage

    return [(name, wrapped(i, stage)) for i, (name, stage) in enumerate(stages)]


STAGES = _in_turn([("toxicity", toxicity), ("near copies", near_copies), ("secret scan", secret_scan), ("source mix", source_mix), ("packing", packing)])

#: Learned scores and tokenizers can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each kept is written to the shared folder and read by the next, then deleted."""
    docs, stored = read_documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        written: list[str] = []
        kept = stage(spark, docs, sf_dir)
        with tables_into(written):
            docs = table(kept, "stage")
        drop_tables(spark, stored)
        stored = written
    return STAGES[-1][1](spark, docs, sf_dir)
