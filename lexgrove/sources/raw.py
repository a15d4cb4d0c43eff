"""Raw files and tables kept by document (OP-S02, S03, S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """name, content, sha256, state: the files below path held against manifest (name, source_sha256).

    state: same, changed, new (no hash known), unlisted, or missing (no such file).
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))
    met = files.join(manifest.select("name", "source_sha256", F.lit(True).alias("_listed")), "name", "full")
    state = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("_listed").isNull(), "unlisted")
        .when(F.col("source_sha256").isNull(), "new")
        .when(F.col("sha256") == F.col("source_sha256"), "same")
        .otherwise("changed")
    )
    return met.select("name", "content", "sha256", state.alias("state"))


def replace_documents(rows: DataFrame, path: str, by: str = "document_id") -> None:
    """Replaces the documents that rows hold, and no other, in a table laid out by document."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
