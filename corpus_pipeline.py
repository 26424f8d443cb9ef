"""Corpus pipeline: raw documents to token ids of a clean, mixed corpus.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes
each stage's result as Parquet and reads it again for the next one.  All but
the last return the columns of documents.

A stage's own working tables and broadcast variables are deleted when the next
stage begins: by then its result has been written, so nothing reads them any
more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoich.llm import bpe, language, mixing, ngram_join, privacy
from stoich.llm.common import is_crc_fold, materialise, release, shared_values
from stoich.llm.queries import tokenizer_file
from stoich.session import remove_tables, written_tables
from stoich.sources.tables import table

_working: list[str] = []        # working tables of the stage that ran last
_values: list[Broadcast] = []   # and its broadcast variables


def _stage(function: Callable) -> Callable:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_tables(spark, _working)
        release(spark, _values)
        before, known = set(written_tables()), shared_values()
        result = function(spark, docs, sf_dir)
        _working[:] = [p for p in written_tables() if p not in before]
        _values[:] = [b for b in shared_values() if b not in known]
        return result

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; lang becomes that language."""
    return language.reject_undetermined(docs, ~is_crc_fold(F.col("doc_id"), 0))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return ngram_join.one_of_each(docs)


@_stage
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and revealing terms replaced."""
    return privacy.sanitised(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, repeats included."""
    return mixing.mixed_texts(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.encode_documents(docs, tokenizer_file())


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("privacy", sanitise),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Automata, rotations of slots and tokens are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
