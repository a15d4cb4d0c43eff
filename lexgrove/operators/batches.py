"""Batches for services with limits on items and tokens (OP-R09, T09, C06)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def estimated_tokens(c: Column) -> Column:
    """OP-C06: a third of the characters, rounded down, plus one; null counts as empty."""
    return (F.coalesce(F.length(c), F.lit(0)) / 3).cast("long") + 1


def token_batches(rows: DataFrame, key: str, text: str, items: int = 64, budget: int = 8000) -> DataFrame:
    """id, tokens, part, batch: texts of like length together, at most items and budget a batch; a longer text goes alone.

    Ranges of lengths are dealt to tasks, which hold no more than one Arrow batch; (part, batch) names a batch.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = size = total = 0
        for each in batches:
            out = []
            for t in each["tokens"]:
                if size and (size == items or total + t > budget):
                    n, size, total = n + 1, 0, 0
                size, total = size + 1, total + t
                out.append(n)
            yield each.assign(batch=out)

    sized = rows.select(F.col(key).alias("id"), estimated_tokens(F.col(text)).alias("tokens"))
    dealt = sized.repartitionByRange("tokens", "id").sortWithinPartitions("tokens", "id").withColumn("part", F.spark_partition_id().cast("long"))
    return dealt.mapInPandas(run, f"id {kind}, tokens long, part long, batch long")
