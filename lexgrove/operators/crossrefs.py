"""The graph of references between provisions (OP-G08, G10, J05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.citations import find_links


def edges(provisions: DataFrame, regulations: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """source, start, end, target: each phrase's first candidate that exists and isn't the provision itself.

    provisions: id, text. Equal rows give equal edges once.
    """
    links = provisions.select(F.col("id").alias("source"), F.explode(find_links(F.col("id"), F.col("text"), regulations)).alias("_l"))
    each = links.select("source", F.col("_l.start").alias("start"), F.col("_l.end").alias("end"), F.posexplode("_l.targets").alias("_n", "target"))
    known = provisions.select(F.col("id").alias("target")).distinct()
    met = each.where("target <> source").join(known, "target", "left_semi")
    return met.groupBy("source", "start", "end").agg(F.min_by("target", "_n").alias("target"))
