"""Red-team cases as a batch of checks (OP-E06, E07, A15).

A case is an input and its checks; each type of check is one plan over all cases, and the results are their union.
{cpf} in a text stands for a made, valid CPF of the case, {long} for as many letters as its length says. Cases and checks
with nulls in them hold nothing: a check of an unknown type is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.privacy import redact
from lexgrove.functions.text import synthetic_cpf
from lexgrove.operators.answers import prompt_documents, prompts
from lexgrove.operators.grounding import check_citations
from lexgrove.operators.retrieval import input_problem, named

CASES = "case string, input string, length int, checks array<struct<type: string, contains: array<string>, absent: array<string>, citations: array<struct<id: string, quote: string>>, issue: string, provision: string>>"


def filled(text: Column) -> Column:
    """A text with its placeholders filled; the case and its length stand in columns."""
    letters = F.repeat(F.lit("a"), F.greatest(F.coalesce("length", F.lit(1)), F.lit(1)))
    return F.replace(F.replace(text, F.lit("{cpf}"), synthetic_cpf(F.col("case"))), F.lit("{long}"), letters)


def outcome(ok: Column, detail: Column) -> list[Column]:
    good = F.coalesce(ok, F.lit(False))
    return [F.when(good, "passed").otherwise("failed").alias("outcome"), F.when(good, "").otherwise(detail).alias("detail")]


def redactions(checks: DataFrame) -> DataFrame:
    kept = redact(checks.withColumn("text", F.col("input")))
    none = F.array().cast("array<string>")
    within = lambda x: F.contains(F.coalesce("text", F.lit("")), filled(x))
    missing = F.size(F.filter(F.coalesce("k.contains", none), lambda x: ~within(x)))
    leaked = F.size(F.filter(F.coalesce("k.absent", none), within))
    return kept.select("case", "check", *outcome((missing == 0) & (leaked == 0), F.format_string("missing=%d leaked=%d", missing, leaked)))


def citations(checks: DataFrame, provisions: DataFrame) -> DataFrame:
    """Every citation must have the issue that the check names; null: none."""
    each = checks.select("case", "check", "n", F.col("k.issue").alias("wanted"), F.explode_outer("k.citations").alias("c")).select("case", "check", "n", "wanted", F.col("c.id").alias("id"), F.col("c.quote").alias("quote"))
    found = check_citations(each, provisions, "id").groupBy("case", "check", "n").agg(F.bool_and(F.col("issue").eqNullSafe(F.col("wanted"))).alias("ok"), F.array_join(F.array_sort(F.collect_list(F.coalesce("issue", F.lit("none")))), ",").alias("issues"))
    return found.select("case", "check", *outcome(F.col("ok"), F.concat(F.lit("issues="), "issues")))


def lost_references(checks: DataFrame, provisions: DataFrame) -> DataFrame:
    asked = checks.select(F.struct("case", "check", "n").alias("qid"), F.col("input").alias("text"), F.col("k.provision").alias("provision"))
    found = asked.join(named(asked.select("qid", "text"), provisions).select("qid", "missing"), "qid")
    return found.select("qid.case", "qid.check", *outcome(F.array_contains("missing", F.col("provision")), F.concat(F.lit("missing="), F.array_join("missing", ","))))


def isolation(checks: DataFrame, provisions: DataFrame) -> DataFrame:
    """OP-E07: a prompt holds one document, exactly the first provision's text, and the redacted question in a block of its own."""
    one = provisions.orderBy("id").limit(1)
    asked = redact(checks.select("case", "check", F.struct("case", "n").alias("qid"), F.col("input").alias("text")))
    hits = asked.select("qid").crossJoin(one.select("id")).withColumn("rank", F.lit(1))
    turn = prompts(asked.select("qid", "text"), prompt_documents(hits, provisions))
    kind = "struct<content: array<struct<type: string, text: string, source: struct<content: array<struct<type: string, text: string>>>>>>"
    read = turn.withColumn("m", F.from_json("message", kind)).join(asked.drop("n_cnpj", "n_cpf", "n_email", "n_phone"), "qid").crossJoin(one.select(F.coalesce("text", F.lit("")).alias("own")))
    document, question = F.element_at("m.content", 1), F.element_at("m.content", 2)
    ok = (
        (F.size("m.content") == 2)
        & (document["type"] == "document")
        & (F.size(document["source"]["content"]) == 1)
        & (document["source"]["content"][0]["text"] == F.col("own"))
        & (question["text"] == F.concat(F.lit("<pergunta>\n"), F.coalesce("text", F.lit("")), F.lit("\n</pergunta>")))
    )
    return read.select("case", "check", *outcome(ok, F.lit("the prompt mixes what it is made of")))


def run(cases: DataFrame, provisions: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """case, check, outcome (passed, failed, skipped), detail: a row for each check.

    cases: CASES. summary: case, refused, as a search over the redacted inputs gives it; without it, refusals are skipped.
    """
    checks = cases.withColumn("input", filled(F.col("input"))).select("case", "input", "length", F.posexplode("checks").alias("n", "k")).withColumn("check", F.col("k.type"))
    of = lambda kind: checks.where(F.col("check") == kind)
    out = redactions(of("redaction")).unionByName(citations(of("validator"), provisions)).unionByName(lost_references(of("missing_reference"), provisions)).unionByName(isolation(of("prompt_isolation"), provisions))
    limits = of("api_limit").select("case", "check", *outcome(input_problem(F.col("input"), F.lit(None).cast("int")).isNotNull(), F.lit("accepted")))
    out = out.unionByName(limits)
    known = ["redaction", "validator", "missing_reference", "prompt_isolation", "api_limit"]
    if summary is not None:
        told = of("refusal").join(summary.select("case", "refused"), "case", "left")
        out = out.unionByName(told.select("case", "check", *outcome(F.col("refused").isNotNull(), F.lit("answered"))))
        known.append("refusal")
    rest = checks.where(F.col("check").isNull() | ~F.col("check").isin(known))
    return out.unionByName(rest.select("case", "check", F.lit("skipped").alias("outcome"), F.lit("can't be run here").alias("detail")))
