"""Changes of a corpus as new snapshots of its documents land (OP-ST02, J06, H12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrove.sources.raw import replace_documents

CONTENT = ["parent_id", "kind", "label", "path", "text", "amendments", "revoked", "vetoed"]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, id, change (added, removed, changed), old, new (texts): of the documents in new; order and dates don't count."""
    parts = [c for c in CONTENT if c in new.columns]
    side = lambda df, name: df.select("document_id", "id", F.struct(*parts).alias(name))
    old = old.join(new.select("document_id").distinct(), "document_id", "left_semi")
    met = side(old, "_o").join(side(new, "_n"), ["document_id", "id"], "full").where("not (_o <=> _n)")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return met.select("document_id", "id", kind.alias("change"), F.col("_o.text").alias("old"), F.col("_n.text").alias("new"))


def watch(snapshots: DataFrame, state: str, log: str, checkpoint: str) -> StreamingQuery:
    """Takes what has landed: each batch's changes go to log/batch=N, then its documents replace those in state.

    A batch that is run again after a failure keeps the changes it had written whole. A batch holds whole documents,
    each once: the producer lands a document in one file.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{log}/batch={number}"
        if not exists(spark, f"{at}/_SUCCESS"):
            old = spark.read.schema(batch.schema).parquet(state) if exists(spark, state) else batch.limit(0)
            changes(old, batch).write.mode("overwrite").parquet(at)
        replace_documents(batch, state)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
