"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing, sharding.

Each stage takes all that its predecessor kept. The first three drop documents, mixing repeats and
drops them by drawn counts, sharding says where each goes.

Nulls, empty and long texts, ties, repeated rows and empty tables: as the operators' docstrings say. A
repeated doc_id, as mixing makes them, is a document of its own for each row. Columns of documents
called shard, slot or moved are replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import decontamination, mixing, near_dedup, shards, toxicity
from lexgrove.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op 9's model rejects go. It is fitted on the labelled rows among docs."""
    return toxicity.clean(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source's target weight, in shuffled order. deal_shards() deals slots in an order of its own that keeps copies apart."""
    return mixing.mixed(docs).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard, its slot there, and whether it moved."""
    return shards.resharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Fitted models and MinHash classes can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder, reread by the next, and deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
