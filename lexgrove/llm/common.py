"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    A local session that names none (tests) gets one below its warehouse; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, reread: cuts lineage and survives the loss of executors.

    discard() deletes it; a table that a returned DataFrame still reads stays until its user does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables, once all that was computed from them is written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text, null as empty; nothing else, so further columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[memoryview, list[int]]:
    """Bytes of an Arrow string column without a copy, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1].tolist()
    data = column.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


def texts(batch: pa.RecordBatch, name: str = "text"):
    """The rows of a string column as bytes, one after another."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    for a, b in zip(offsets, offsets[1:]):
        yield bytes(data[a:b])
