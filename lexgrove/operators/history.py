"""Earlier wordings from compiled texts (OP-H01 to H04, H13, J15).

A compiled page strikes what an act replaced and prints it before what is in force. A run of struck
lines that starts with an article is a text of its own, once for each time its article begins; any
other run belongs to the provision that starts in the very next line, and only its lines of that
provision's label count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.grammar import amending_act
from lexgrove.functions.phrases import Phrase, tokens
from lexgrove.operators.structure import ARTICLE, ITEM, label_of, normalized, notes_in, parse, without_notes, without_vigencia

#: Fixed values.
LATE = Phrase("promulgacao partes vetadas")
LATE_REVIEW = "vetoed part promulgated later: in-force date not established"


def introduced_by(notes: Column) -> Column:
    """OP-H04: the act that the first note of a wording or an addition names; null without one."""

    @F.pandas_udf("string")
    def run(each: pd.Series) -> pd.Series:
        return each.map(lambda own: next((a for n in (own if own is not None else []) if n and (a := amending_act(n))), None))

    return run(notes)


def promulgated_late(notes: Column) -> Column:
    """OP-H13: if a note speaks of vetoed parts that were promulgated later."""

    @F.pandas_udf("boolean")
    def run(each: pd.Series) -> pd.Series:
        return each.map(lambda own: any(n and next(LATE.search(tokens(n)), None) is not None for n in (own if own is not None else [])))

    return run(notes)


def struck_parts(line: Column) -> Column:
    """OP-H03: a struck line's level, label, text without notes, and notes; nulls where it starts no provision."""

    @F.pandas_udf("struct<level: int, label: string, text: string, notes: array<string>>")
    def run(lines: pd.Series) -> pd.DataFrame:
        def each(x: str | None) -> tuple:
            found = label_of(normalized(x or ""))
            if not found or found.level == ITEM:
                return None, None, None, []
            return found.level, found.shown, without_vigencia(normalized(without_notes(found.rest))), notes_in(x)

        return pd.DataFrame([each(x) for x in lines], columns=["level", "label", "text", "notes"]).astype({"level": "Int32"})

    return run(line)


def struck_runs(blocks: DataFrame) -> DataFrame:
    """Struck lines with run (its first line's number), last (its last one's) and by_article."""
    order = W.partitionBy("document_id").orderBy("line_no")
    begins = F.when(F.lag("struck", 1, False).over(order), 0).otherwise(1)
    struck = blocks.withColumn("_b", F.when(F.col("struck"), begins).otherwise(0)).withColumn("_r", F.sum("_b").over(order)).where("struck")
    run, within = W.partitionBy("document_id", "_r"), W.partitionBy("document_id", "_r").orderBy("line_no")
    parts = struck.withColumn("p", struck_parts(F.col("line")))
    first = F.first("p.level", True).over(run.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nth = F.greatest(F.sum(F.when(F.col("p.level") == ARTICLE, 1).otherwise(0)).over(within), F.lit(1))
    return parts.select("document_id", "line_no", "line", "p", F.min("line_no").over(run).alias("run"), F.max("line_no").over(run).alias("last"), F.coalesce(first == ARTICLE, F.lit(False)).alias("by_article"), nth.alias("nth"))


def extract_history(blocks: DataFrame) -> DataFrame:
    """id, seq, text, introduced_by, review: the wordings of each provision in force, oldest first, the current one last.

    blocks: document_id, line_no (without gaps), line, struck. Provisions that never changed have no rows.
    """
    blocks = blocks.select("document_id", "line_no", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("struck", F.lit(False)).alias("struck"))
    tree = parse(blocks.withColumn("line", F.when(F.col("struck"), "").otherwise(F.col("line"))))
    now = tree.where("error is null and not revoked and not vetoed").select("document_id", "id", "label", "start_line", "text", F.col("amendments").alias("notes"))
    runs = struck_runs(blocks)
    # Texts of their own: parsed under a name that says which, dropped where an identifier comes twice.
    named = F.concat_ws("#", "document_id", F.col("run").cast("string"), F.col("nth").cast("string"))
    old = parse(runs.where("by_article").select(named.alias("document_id"), "line_no", "line"))
    clean = F.max("error").over(W.partitionBy("document_id")).isNull()
    old = old.withColumn("_clean", clean).where("_clean and text <> ''")
    blocks_old = old.select(F.regexp_replace("id", "#[0-9]+#[0-9]+", "").alias("id"), F.col("start_line").alias("at"), "text", F.col("amendments").alias("notes"))
    lines_old = runs.where("not by_article and p.text <> ''").alias("r").join(now.alias("n"), (F.col("r.document_id") == F.col("n.document_id")) & (F.col("r.last") + 1 == F.col("n.start_line")) & (F.col("r.p.label") == F.col("n.label")))
    lines_old = lines_old.select("n.id", F.col("r.line_no").alias("at"), F.col("r.p.text").alias("text"), F.col("r.p.notes").alias("notes"))
    earlier = blocks_old.join(now.select("id"), "id", "left_semi").unionByName(lines_old)
    every = earlier.withColumn("_now", F.lit(0)).unionByName(now.select("id", F.col("start_line").alias("at"), "text", "notes", F.lit(1).alias("_now")))
    every = every.select("id", "_now", "at", "text", introduced_by(F.col("notes")).alias("introduced_by"), F.when(promulgated_late(F.col("notes")), LATE_REVIEW).alias("review"))
    order, whole = W.partitionBy("id").orderBy("_now", "at"), W.partitionBy("id")
    kept = every.withColumns({"seq": F.row_number().over(order).cast("long"), "_n": F.count("*").over(whole)}).where("_n > 1 or introduced_by is not null")
    return kept.select("id", "seq", "text", "introduced_by", "review")
