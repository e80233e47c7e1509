"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents. Each is written
as Parquet before the next reads it, so that a lost executor costs no earlier stage.

Defined results, of every stage: an empty table gives an empty one; further columns are kept as they are, whatever their names; very long texts are read whole. Null and empty texts stay to the end, where
they have no ids: they aren't toxic, have no lines and no shingles, and hold no benchmark. Repeated rows are judged alike by toxicity, lines and benchmark; near-dedup keeps one of those that have words and a doc_id.
Ties: the first occurrence of a line is that of the least doc_id, and the smallest doc_id of a group of copies stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from foliant.llm.common import remove, shared_dir, table, write
from foliant.llm.entries import TOKENIZERS


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled documents of ``sf_dir``, finds toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def boilerplate_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many sources stay where they are first; documents that lose all of their words go."""
    return line_dedup.strip_boilerplate(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays."""
    return near_dedup.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are removed; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests."""
    return bpe.encode_documents(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("line dedup", boilerplate_out),
    ("MinHash near-dedup", near_copies_out),
    ("benchmark decontamination", leaks_out),
    ("BPE", tokens),
]

#: Classifier, suffix automaton and BPE aren't SQL; the tests hold the operators against brute-force versions and run the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is read back from its written table. A stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/foliant-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        write(out, f"{root}/{k}")
        if k:
            remove(spark, f"{root}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
    return docs
