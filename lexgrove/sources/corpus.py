"""Manifests, documents, histories and vectors as files; what an ingest needs (OP-S10 to S16, S20 to S22, S24, S32, S33, S37, N04)."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.grammar import ID

PROVISION = "id string, document_id string, parent_id string, kind string, label string, path array<string>, text string, amendments array<string>, revoked boolean, vetoed boolean, ordinal int, valid_from date, valid_to date"
DOCUMENT = f"id string, title string, kind string, source_url string, retrieved_at date, source_sha256 string, redistribution_basis string, provisions array<struct<{PROVISION}>>"
VERSION = "struct<text: string, introduced_by: string, valid_from: date, valid_to: date, review: string>"
HISTORY = f"document_id string, source_sha256 string, provisions array<struct<provision_id: string, versions: array<{VERSION}>>>"


def read_yaml(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The list called name of a small YAML file, by any path that Spark reads. An absent or empty list has no rows."""
    import yaml

    body = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows = [json.dumps(r, default=str, ensure_ascii=False) for r in (yaml.safe_load(body) or {}).get(name) or []]
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def write_yaml(rows: DataFrame, path: str, name: str, key: str) -> None:
    """A small table as a YAML list in the order of key; comments that lead the file stay. path: a file of this machine."""
    import yaml

    target = Path(path)
    lines = target.read_text(encoding="utf-8").splitlines(keepends=True) if target.exists() else []
    lead = next((i for i, x in enumerate(lines) if x.strip() and not x.startswith("#")), len(lines))
    items = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows.orderBy(key).collect()]
    target.write_text("".join(lines[:lead]) + yaml.safe_dump({name: items}, allow_unicode=True, sort_keys=False), encoding="utf-8")


def write_documents(documents: DataFrame, provisions: DataFrame, path: str) -> None:
    """OP-S11: one JSON line a document, with its provisions in order, in a folder of its own."""
    each = provisions.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*[c.split()[0] for c in PROVISION.split(", ")]).alias("p")))).alias("_p"))
    full = documents.join(each, "id", "left").withColumn("provisions", F.transform("_p", lambda x: x["p"])).drop("_p")
    full.withColumn("document", F.col("id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").json(path)


def read_documents(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """DOCUMENT columns and state: current, stale (made from other bytes than manifest's source_sha256 says), unlisted."""
    listed = manifest.select("id", F.col("source_sha256").alias("_sha"), F.lit(True).alias("_listed"))
    met = spark.read.schema(DOCUMENT).json(path, recursiveFileLookup=True).join(listed, "id", "left")
    state = F.when(F.col("_listed").isNull(), "unlisted").when(F.col("_sha").eqNullSafe(F.col("source_sha256")), "current").otherwise("stale")
    return met.withColumn("state", state).drop("_sha", "_listed")


def provisions_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.inline("provisions"))


def read_versions(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """OP-S12, S33: id, seq (from 1), text, introduced_by, valid_from, valid_to, review: only of documents made from the same bytes."""
    whole = spark.read.schema(HISTORY).option("multiLine", True).json(path)
    fresh = whole.join(documents.select(F.col("id").alias("document_id"), "source_sha256").distinct(), ["document_id", "source_sha256"], "left_semi")
    each = fresh.select(F.explode("provisions").alias("p")).select(F.col("p.provision_id").alias("id"), F.posexplode("p.versions").alias("_n", "v"))
    return each.select("id", (F.col("_n") + 1).cast("long").alias("seq"), "v.*")


def save_vectors(vectors: DataFrame, path: str, model: str, corpus_sha256: str) -> None:
    """OP-S14: id, v, with the model and the corpus they were made of."""
    vectors.select("id", "v", F.lit(model).alias("model"), F.lit(corpus_sha256).alias("corpus_sha256")).write.mode("overwrite").parquet(path)


def check_vectors(vectors: DataFrame, expected: DataFrame, corpus_sha256: str, dimension: int) -> DataFrame:
    """OP-S15, X03, R11: id, problem: missing, unexpected, stale, of another dimension. No rows: the vectors may be used."""
    want = expected.select("id", F.lit(True).alias("_w")).distinct()
    met = vectors.select("id", "corpus_sha256", F.size("v").alias("_d"), F.lit(True).alias("_h")).join(want, "id", "full")
    problem = (
        F.when(F.col("_h").isNull(), "missing")
        .when(F.col("_w").isNull(), "unexpected")
        .when(~F.col("corpus_sha256").eqNullSafe(F.lit(corpus_sha256)), "stale")
        .when(F.col("_d") != dimension, "dimension")
    )
    return met.select("id", problem.alias("problem")).where("problem is not null")


#: Fixed value: models whose names begin so share one space.
SHARED_SPACE = "voyage-4"


def model_family(model: Column) -> Column:
    """OP-C12: models of one family have one space; others are families of their own."""
    return F.when(model.startswith(SHARED_SPACE), SHARED_SPACE).otherwise(model)


def space_problems(meta: DataFrame, model: str, dimension: int) -> DataFrame:
    """OP-R11: problem: why a model's vectors can't be searched in an index with this meta (key, value). No rows: they can."""
    held = meta.agg(F.max(F.when(F.col("key") == "model", F.col("value"))).alias("m"), F.max(F.when(F.col("key") == "dimension", F.col("value"))).alias("d"))
    family = F.when(~model_family(F.col("m")).eqNullSafe(model_family(F.lit(model))), F.concat(F.lit("index of "), F.coalesce("m", F.lit("no model")), F.lit(f", query of {model}")))
    size = F.when(~F.col("d").cast("int").eqNullSafe(F.lit(dimension)), F.concat(F.lit("index of dimension "), F.coalesce("d", F.lit("unknown")), F.lit(f", query of {dimension}")))
    return held.select(F.explode(F.array_compact(F.array(family, size))).alias("problem"))


def to_embed(chunks: DataFrame, indexed: DataFrame, model: str) -> DataFrame:
    """OP-S21: the chunks (id, document_id, source_sha256, ...) of documents that aren't indexed from these bytes by this model."""
    have = indexed.where(F.col("model") == model).select(F.col("id").alias("document_id"), "source_sha256").distinct()
    return chunks.join(have, ["document_id", "source_sha256"], "left_anti")


def first_vectors(chunks: DataFrame, *choices: DataFrame) -> DataFrame:
    """OP-S22, S32: chunks with v: of the first of choices (id, v) that has the id; null where none has."""
    out, names = chunks, []
    for n, choice in enumerate(choices):
        names.append(f"_v{n}")
        out = out.join(choice.select("id", F.col("v").alias(names[-1])), "id", "left")
    return out.withColumn("v", F.coalesce(*names)).drop(*names)


def latest_meta(entries: DataFrame) -> DataFrame:
    """OP-S20: key, value: the value last set. entries: key, value, at; ties go to the greater value."""
    return entries.groupBy("key").agg(F.max(F.struct("at", "value")).alias("_e")).select("key", F.col("_e.value").alias("value"))


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """OP-F07, J13, X04: the keys of rows that known doesn't have, each once; a null key is unknown."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """OP-A21, P18: keys that more than one row has, and n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def listed(rows: DataFrame, by: str, what: str) -> DataFrame:
    """OP-A02: by, and what: its different values there, in order, joined by commas."""
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(what)), ",").alias(what))


def violations(provisions: DataFrame) -> DataFrame:
    """rule, id: what breaks the model: malformed, foreign (not of its document), orphan, duplicate, ordinal."""
    p = provisions.select("id", "document_id", "parent_id", "ordinal")
    parents = p.select(F.col("id").alias("parent_id"), F.col("document_id").alias("_doc")).distinct()
    rules = F.array(
        F.when(~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "malformed"),
        F.when(~F.coalesce(F.startswith("id", F.concat("document_id", F.lit(":"))), F.lit(False)), "foreign"),
        F.when(F.col("parent_id").isNotNull() & ~F.col("_doc").eqNullSafe(F.col("document_id")), "orphan"),
        F.when(F.col("_n") > 1, "duplicate"),
        F.when(~F.coalesce(F.col("ordinal") >= 0, F.lit(False)), "ordinal"),
    )
    met = p.withColumn("_n", F.count("*").over(W.partitionBy("document_id", "id"))).join(parents, "parent_id", "left")
    return met.select(F.explode(F.array_compact(rules)).alias("rule"), "id").distinct()
