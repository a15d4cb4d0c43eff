"""Histories: differences, points in time, runs (OP-H06, J06, J08, W02, W03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values.
ORIGINAL = "original wording: in force as provided by the act's own vigência clause"
UNAMENDED = "no recorded amendments: the current wording, subject to the act's vigência"


def diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """OP-J06: key, change (added, removed, changed); what is alike doesn't come out."""
    a = old.select(key, F.struct(*content).alias("_old"))
    b = new.select(key, F.struct(*content).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, change.alias("change"))


def version_at(versions: DataFrame, when: str) -> DataFrame:
    """OP-H06: id, seq, certain: the last version by seq that had begun; the first, uncertain, where none had.

    versions: id, seq, valid_from (may be null), and maybe introduced_by and review. A version that a later act
    brought in doesn't exist before its date: seq is null, and certain. The chosen version is certain unless it
    has a review or the next one has no date. A lead and one aggregation, no list of a provision's versions.
    """
    day, order = F.lit(when).cast("date"), W.partitionBy("id").orderBy("seq")
    late = F.col("introduced_by").isNotNull() & F.col("valid_from").isNotNull() if "introduced_by" in versions.columns else F.lit(False)
    plain = F.col("review").isNull() if "review" in versions.columns else F.lit(True)
    sure = plain & (F.lead("seq").over(order).isNull() | F.lead("valid_from").over(order).isNotNull())
    each = versions.select("id", F.struct("seq", sure.alias("sure"), late.alias("late")).alias("_v"), (F.col("valid_from") <= day).alias("_begun"))
    found = each.groupBy("id").agg(F.max(F.when(F.col("_begun"), F.col("_v"))).alias("at"), F.min("_v").alias("first"))
    seq = F.when(F.col("at").isNotNull(), F.col("at.seq")).when(~F.col("first.late"), F.col("first.seq"))
    certain = F.when(F.col("at").isNotNull(), F.col("at.sure")).otherwise(F.col("first.late"))
    return found.select("id", seq.alias("seq"), certain.alias("certain"))


def wording_on(provisions: DataFrame, versions: DataFrame, when: str) -> DataFrame:
    """OP-H07, H14: id, text, introduced_by, valid_from, valid_to, certain, review on a day; what wasn't there yet has no row.

    provisions: id, text. versions: as dated() gives them. A provision without versions keeps its current text, uncertain.
    """
    chosen = version_at(versions, when).withColumnRenamed("seq", "_seq")
    full = versions.select(F.col("id"), F.col("seq").alias("_seq"), F.col("text").alias("_text"), "introduced_by", "valid_from", "valid_to", "review")
    known = chosen.join(full, ["id", "_seq"], "left").withColumn("_known", F.lit(True))
    met = provisions.select("id", F.col("text").alias("_now")).join(known, "id", "left").where("_known is null or _seq is not null")
    text = F.when(F.col("_known"), F.col("_text")).otherwise(F.col("_now"))
    review = F.when(F.col("_known"), F.col("review")).otherwise(UNAMENDED)
    return met.select("id", text.alias("text"), "introduced_by", "valid_from", "valid_to", F.coalesce("certain", F.lit(False)).alias("certain"), review.alias("review"))


def dated(versions: DataFrame, acts: DataFrame) -> DataFrame:
    """OP-H05, J09, W02: versions (id, seq, text, introduced_by, review) with valid_from, valid_to and a review where no date is known.

    acts: name (each once), in_force_from.
    """
    known = acts.select(F.col("name").alias("introduced_by"), F.col("in_force_from").alias("_d"))
    met = versions.join(known, "introduced_by", "left")
    start = F.when(F.col("introduced_by").isNotNull() & F.col("review").isNull(), F.col("_d"))
    why = F.coalesce("review", F.when(F.col("introduced_by").isNull(), ORIGINAL).when(F.col("_d").isNull(), F.concat(F.lit("no in-force date for "), "introduced_by")))
    each = met.select("id", "seq", "text", "introduced_by", start.alias("valid_from"), why.alias("review"))
    return each.withColumn("valid_to", F.lead("valid_from").over(W.partitionBy("id").orderBy("seq")))


def islands(rows: DataFrame, key: str, order: list[str], kind: str, item: str) -> DataFrame:
    """OP-W03: runs of neighbouring rows of one kind: key, kind, first, last, n."""
    run = F.row_number().over(W.partitionBy(key).orderBy(*order)) - F.row_number().over(W.partitionBy(key, kind).orderBy(*order))
    marked = rows.select(key, F.col(kind).alias("kind"), F.col(item).alias("_item"), run.alias("_run"))
    return marked.groupBy(key, "kind", "_run").agg(F.min("_item").alias("first"), F.max("_item").alias("last"), F.count("*").alias("n")).drop("_run")
