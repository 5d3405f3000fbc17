"""From raw documents to encoded training text, stage by stage.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, and returns a DataFrame; the
next stage gets it written and read again. All but the last return the columns of ``documents``, extra columns
included whatever their names. In all stages null texts count as empty and an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import bpe_codec, exact_dedup, mixing, simhash, toxicity
from vellumine.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Empty texts are scored like others, repeated and null ids row by row; a score on the threshold goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest doc_id; null ids are smaller than any.

    Of rows that agree in doc_id and text one stays; a doc_id with several texts keeps a row for each that wins.
    """
    return exact_dedup.keep_winners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group linked by five-word shingles (similarity 0.8 or more), the document of the least doc_id.

    SimHash blocks and bands of minima find the pairs, whole shingle sets decide. Null ids come last; ties of id go by text and then by the other columns. Empty texts are one group.
    """
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is a source.

    Documents without words stay once; rows that agree in doc_id, source and text share their copies evenly.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their number, and digests of ids and of the decoded text: one row per copy that the mix took.

    An empty text has no ids; repeated and null doc_ids are kept as they are.
    """
    return bpe_codec.bpe_round_trip(docs, keep=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() and the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
