"""From raw documents to packed training sequences, in stages that each write their result for the next.

language: documents of which less than a quarter is in a known language go. near_dedup: of each group of near-duplicates one
document stays, by op9's method with longer fingerprints, and the texts decide.
secrets: found secrets are replaced by a mark. mix: sources are mixed to their target weights; documents are repeated,
shortened or left out for it. packing: the mixed documents become pieces, each with its place in a sequence.

Edge cases are those of the operators; an empty table goes through all stages to an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugework.llm.common import MADE, scratch, written
from gaugework.llm.language_id import drop_unidentified, fit, held_out
from gaugework.llm.packing import pack_documents
from gaugework.llm.secrets import redact_secrets
from gaugework.llm.simhash import keep_one
from gaugework.llm.source_mixing import mix_documents
from gaugework.session import remove_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage has made for its result.
LEFT: list[str] = []


def left_behind(stage: Stage) -> Stage:
    """The stage; what it makes for its result is in LEFT."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        first = len(MADE)
        out = stage(spark, docs, sf_dir)
        LEFT[:] = MADE[first:]
        return out

    return run


def after_written(stage: Stage) -> Stage:
    """The stage, which first removes what the stage before it has left, once that one's result is written: if its input is
    a plain table of files, none of them among these. An input that is still to be computed keeps all."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if LEFT and docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
            files = docs.inputFiles()
            if not any(path.rpartition("/")[2] in f for path in LEFT for f in files):
                for path in LEFT:
                    remove_dir(spark, path)
        return left_behind(stage)(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs, fit(docs.where(~held_out(docs["doc_id"]))))


@left_behind
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@after_written
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@after_written
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs, weights=(5, 2, 1), cap=3, share=1.0)


@after_written
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secrets), ("mix", mix), ("packing", packing)]

#: Models, hashes and tokenizers are no SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):  # the stages before the last
        for name, stage in STAGES:
            with scratch(spark):  # a stage's own tables
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
