"""Verbatim citation checks and the strict verdict on an answer (OP-V01, V02, A17, F11, J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.grammar import ID
from lexgrove.functions.text import normalize_for_match


def check_citations(citations: DataFrame, corpus: DataFrame, key: str, least: int = 10) -> DataFrame:
    """citations (key, quote, ...) with known_id and issue: the first that holds of malformed, unknown, revoked, vetoed, too_short, not_found, or null.

    corpus: key, text, and, if it has them, revoked and vetoed. A key that is a string is a provision's id, and malformed
    if it is null or doesn't follow their grammar; others have none. A null text or quote is an empty one. Keyed, so an
    equi-join; what is compared is normalised after it, so only texts that are cited.
    """
    flag = lambda name: (F.col(name) if name in corpus.columns else F.lit(False)).alias(f"_{name}")
    known = corpus.select(F.col(key).alias("known_id"), F.col("text").alias("_text"), flag("revoked"), flag("vetoed"))
    own = citations[key]
    is_id = citations.schema[key].dataType.typeName() == "string"
    malformed = ~F.coalesce(own.rlike(ID.removesuffix("$") + r"\z"), F.lit(False)) if is_id else F.lit(False)
    same = lambda c: normalize_for_match(F.coalesce(F.col(c), F.lit("")))
    issue = (
        F.when(F.col("_malformed"), "malformed")
        .when(F.col("known_id").isNull(), "unknown")
        .when(F.col("_revoked"), "revoked")
        .when(F.col("_vetoed"), "vetoed")
        .when(F.length("_quote") < least, "too_short")
        .when(~F.contains(F.col("_text"), F.col("_quote")), "not_found")
    )
    out = citations.withColumn("_malformed", malformed).join(known, own == F.col("known_id"), "left")
    out = out.withColumns({"_quote": F.btrim(same("quote"), F.lit(" .;:,\"'")), "_text": same("_text")})
    return out.withColumn("issue", issue).drop("_text", "_quote", "_malformed", "_revoked", "_vetoed")


#: Words from which on a block says something that needs a citation.
SUBSTANTIVE = 6


def words_in(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0)))


def judge(blocks: DataFrame, citations: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """OP-V02, A17: answer, grounded, n_invalid, uncited_blocks (their numbers, in order), reasons.

    blocks: answer, block (its number), text. citations: answer, block, key, quote. Grounded: no citation has an issue, no block
    of SUBSTANTIVE words or more lacks a valid citation, and there is a valid citation at all. An answer without blocks has no row.
    """
    issues = check_citations(citations.select("answer", "block", key, "quote"), corpus, key).groupBy("answer", "block").agg(F.count_if(F.col("issue").isNull()).alias("_valid"), F.count("issue").alias("_invalid"))
    each = blocks.select("answer", "block", (words_in(F.col("text")) >= SUBSTANTIVE).alias("_says")).join(issues, ["answer", "block"], "left").fillna(0, ["_valid", "_invalid"])
    uncited = F.when(F.col("_says") & (F.col("_valid") == 0), F.col("block"))
    out = each.groupBy("answer").agg(F.sum("_invalid").alias("n_invalid"), F.array_sort(F.collect_list(uncited)).alias("uncited_blocks"), F.sum("_valid").alias("_valid"))
    n = F.size("uncited_blocks")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_invalid") > 0, F.concat(F.col("n_invalid").cast("string"), F.lit(" invalid citation(s)"))),
            F.when(n > 0, F.concat(n.cast("string"), F.lit(" substantive block(s) without a valid citation"))),
            F.when(F.col("_valid") == 0, F.lit("no valid citation")),
        )
    )
    return out.withColumn("reasons", reasons).select("answer", (F.size("reasons") == 0).alias("grounded"), "n_invalid", "uncited_blocks", "reasons")
