"""The index as tables, replaced document by document (OP-S17 to S19, A01, A24).

Tables are folders of Parquet below one path, laid out by document_id. A document is replaced in two steps: its new rows
are written whole to a folder beside the tables, checked, and then take their partitions' places in all tables. A job that
is lost before the second step changes nothing; one that is lost within it is repeated from that folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.sources.corpus import PROVISION

#: The columns of each table.
TABLES = {
    "documents": "id string, title string, kind string, source_url string, retrieved_at date, source_sha256 string, redistribution_basis string, embedding_model string, document_id string",
    "provisions": PROVISION,
    "chunks": "provision_id string, content string, embedding array<float>, document_id string",
    "provision_versions": "provision_id string, seq int, text string, introduced_by string, valid_from date, valid_to date, review string, document_id string",
}


def create(spark: SparkSession, home: str) -> None:
    """OP-S17: the tables, empty, where there are none yet; what is there stays."""
    for name, columns in TABLES.items():
        path = f"{home}/{name}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            spark.createDataFrame([], columns).write.partitionBy("document_id").parquet(path)


def read(spark: SparkSession, home: str, name: str) -> DataFrame:
    kinds = TABLES[name].split("document_id string")[0].rstrip(", ") if not TABLES[name].startswith("id string, document_id") else TABLES[name].replace("document_id string, ", "")
    return spark.read.schema(f"{kinds}, document_id string").parquet(f"{home}/{name}")


def vacate(spark: SparkSession, home: str, name: str, documents: list[str]) -> None:
    for d in documents:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{name}/document_id={d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace(spark: SparkSession, home: str, new: dict[str, DataFrame], documents: list[str]) -> None:
    """The rows of `documents` in the tables that `new` names become those of new; no other document changes."""
    stage = f"{home}/_stage-{uuid.uuid4().hex}"
    for name, rows in new.items():
        own = rows.where(F.col("document_id").isin(documents)).select(*[c.split()[0] for c in TABLES[name].split(", ")])
        own.write.partitionBy("document_id").parquet(f"{stage}/{name}")
    for name in new:
        staged = spark.read.schema(TABLES[name]).parquet(f"{stage}/{name}")
        held = [r[0] for r in staged.select("document_id").distinct().collect()]
        vacate(spark, home, name, [d for d in documents if d not in held])
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{home}/{name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_documents(spark: SparkSession, home: str, documents: DataFrame, provisions: DataFrame, chunks: DataFrame) -> None:
    """OP-S18: documents with all their provisions and chunks. Chunks without a vector, or of a provision that isn't there, are an error before anything changes.

    A replaced document's wordings go with its provisions, as those of a deleted one do.
    """
    ids = [r.id for r in documents.select("id").distinct().collect()]
    lost = chunks.join(provisions.select(F.col("id").alias("provision_id")), "provision_id", "left_anti").count()
    bare = chunks.where("embedding is null or size(embedding) = 0").count()
    if lost or bare:
        raise ValueError(f"{bare} chunks without a vector, {lost} without a provision")
    versions = spark.createDataFrame([], TABLES["provision_versions"])
    replace(spark, home, {"documents": documents.withColumn("document_id", F.col("id")), "provisions": provisions, "chunks": chunks, "provision_versions": versions}, ids)


def replace_versions(spark: SparkSession, home: str, versions: DataFrame, document: str) -> int:
    """OP-S19: the wordings of one document's provisions; how many there are now."""
    own = versions.where(F.col("document_id") == document)
    replace(spark, home, {"provision_versions": own}, [document])
    return read(spark, home, "provision_versions").where(F.col("document_id") == document).count()


def health(spark: SparkSession, home: str) -> DataFrame:
    """OP-A01, A02, A24: documents, provisions, chunks, models (distinct, in order, joined by commas)."""
    counts = [read(spark, home, t).agg(F.count("*").alias(t)) for t in ("documents", "provisions", "chunks")]
    models = read(spark, home, "documents").agg(F.array_join(F.array_sort(F.collect_set("embedding_model")), ",").alias("models"))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(models)
