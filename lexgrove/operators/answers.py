"""Answers from a model's blocks: prompts, citations, status, rendering (OP-V03 to V07, A08 of answers, E14).

A model is called elsewhere, for a batch of prompts; what it gives back is a table of blocks with their citations.
Everything here is a join on a question's number. Questions are redacted (functions.privacy) before they are searched
or put into a prompt. Nulls: a null text is an empty one; a question without hits is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions.text import clip
from lexgrove.operators.grounding import judge
from lexgrove.operators.retrieval import provision_ancestors

LONGEST_CONTEXT = 600
NEAREST = 3
#: What a model answers when the documents don't, an identifier that none has, why answers are refused and how that is told.
NO_SUPPORT = "SEM_BASE"
UNMAPPED = "unknown:art0"
STOPS = {"refusal": "model_refusal", "max_tokens": "truncated"}
MESSAGES = {
    "nonexistent_provision": "O dispositivo citado não existe no corpus.",
    "out_of_scope": "A pergunta trata de norma que não faz parte do corpus (LGPD, Lei de Acesso à Informação e resoluções da ANPD).",
    "low_score": "Nenhum dispositivo do corpus trata do assunto.",
    "model_no_support": "Os dispositivos encontrados não respondem à pergunta.",
    "ungrounded": "A resposta gerada não pôde ser verificada no corpus.",
    "model_refusal": "O modelo recusou a pergunta.",
    "truncated": "A resposta excedeu o limite de tamanho.",
}


def shown_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def message_of(cause: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[cause]


def prompt_documents(hits: DataFrame, provisions: DataFrame) -> DataFrame:
    """OP-V05: qid, index (from 0, by rank), id, title, context, text: one document for each hit.

    context: the path, then the ancestors' labels and texts, outermost first, clipped to LONGEST_CONTEXT.
    """
    own = hits.select("qid", "id", "rank").join(provisions.select("id", "path", F.coalesce("text", F.lit("")).alias("text")), "id")
    up = own.select("qid", "id", F.posexplode(provision_ancestors(F.col("id"))).alias("_n", "_a")).where("_a <> id")
    texts = provisions.where("text <> ''").select(F.col("id").alias("_a"), F.concat("label", F.lit(": "), "text").alias("_t"))
    above = up.join(texts, "_a").groupBy("qid", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]).alias("_above"))
    context = F.array_join(F.concat(F.array(shown_path(F.col("path"))), F.coalesce("_above", F.array().cast("array<string>"))), "\n")
    title = F.concat("id", F.lit(" — "), shown_path(F.col("path")))
    return own.join(above, ["qid", "id"], "left").select("qid", (F.col("rank") - 1).alias("index"), "id", title.alias("title"), clip(context, LONGEST_CONTEXT).alias("context"), "text")


def prompts(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """OP-V05: qid, message: JSON of the one user turn: a cited document for each provision, then the question between tags."""
    source = F.struct(F.lit("content").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))
    document = F.to_json(F.struct(F.lit("document").alias("type"), source.alias("source"), "title", "context", F.struct(F.lit(True).alias("enabled")).alias("citations")))
    each = documents.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", document.alias("d")))), lambda x: x["d"]).alias("_d"))
    asked = F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit("<pergunta>\n"), F.coalesce("text", F.lit("")), F.lit("\n</pergunta>")).alias("text")))
    content = F.array_join(F.concat(F.coalesce("_d", F.array().cast("array<string>")), F.array(asked)), ",")
    return questions.join(each, "qid", "left").select("qid", F.concat(F.lit('{"role":"user","content":['), content, F.lit("]}")).alias("message"))


def mapped(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """OP-V04: qid, block, n, id, quote: a citation's document by its index; one that names none gets an identifier that the checks reject.

    citations: qid, block, n, kind, index, quote.
    """
    place = F.when(F.col("kind") == "content_block_location", F.col("index"))
    met = citations.withColumn("_i", place).join(documents.select("qid", F.col("index").alias("_i"), "id"), ["qid", "_i"], "left")
    return met.select("qid", "block", "n", F.coalesce("id", F.lit(UNMAPPED)).alias("id"), F.coalesce("quote", F.lit("")).alias("quote"))


def answered(summary: DataFrame, hits: DataFrame, provisions: DataFrame, blocks: DataFrame, citations: DataFrame, stops: DataFrame) -> DataFrame:
    """OP-V03, V06, E14: qid, status, refusal, message, details, cited (ids in order, each once), nearest (ids, if refused).

    summary: qid, refused (as search() gives it). hits: qid, id, rank. blocks: qid, block, text. citations: as mapped() gives
    them. stops: qid, stop. In order: what the search refuses or finds nothing for, a model that refused or was cut off, one
    that has no support, and an answer that the strict verdict rejects, with its reasons.
    """
    named = lambda df: df.withColumnRenamed("qid", "answer")
    own = citations.join(hits.select("qid", "id"), ["qid", "id"], "left")
    verdict = judge(named(blocks), named(own), provisions, "id").select(F.col("answer").alias("qid"), "grounded", "reasons")
    said = blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("_said"))
    found = hits.where(F.col("rank") <= NEAREST).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("_near"))
    used = citations.groupBy("qid", "id").agg(F.min(F.struct("block", "n")).alias("_at")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_cited"))
    met = summary.select("qid", "refused")
    for df in (found, stops.select("qid", "stop"), said, verdict, used):
        met = met.join(df, "qid", "left")
    stop = F.create_map(*[F.lit(x) for pair in STOPS.items() for x in pair])[F.coalesce("stop", F.lit(""))]
    cause = F.coalesce(
        "refused",
        F.when(F.col("_near").isNull(), F.lit("low_score")),
        stop,
        F.when(F.trim(F.coalesce("_said", F.lit(""))) == NO_SUPPORT, F.lit("model_no_support")),
        F.when(~F.coalesce("grounded", F.lit(False)), F.lit("ungrounded")),
    )
    none = F.array().cast("array<string>")
    return met.withColumn("refusal", cause).select(
        "qid",
        F.when(F.col("refusal").isNull(), "answered").otherwise("refused").alias("status"),
        "refusal",
        message_of(F.col("refusal")).alias("message"),
        F.when(F.col("refusal") == "ungrounded", F.coalesce("reasons", none)).otherwise(none).alias("details"),
        F.when(F.col("refusal").isNull(), F.coalesce("_cited", none)).otherwise(none).alias("cited"),
        F.when(F.col("refusal").isNotNull(), F.coalesce("_near", none)).otherwise(none).alias("nearest"),
    )


def rendered(answers: DataFrame, blocks: DataFrame, citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """OP-V07: qid, text: an answer's blocks with numbered citations and their sources, or why it was refused and what is nearest."""
    numbers = answers.select("qid", F.col("cited").alias("_cited"))
    marks = citations.join(numbers, "qid").withColumn("_k", F.array_position("_cited", F.col("id"))).where("_k > 0")
    marks = marks.groupBy("qid", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "_k"))), lambda x: F.concat(F.lit(" ["), x["_k"].cast("string"), F.lit("]"))), "").alias("_m"))
    body = blocks.join(marks, ["qid", "block"], "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("block", F.concat(F.coalesce("text", F.lit("")), F.coalesce("_m", F.lit(""))).alias("t")))).alias("_b"))
    body = body.select("qid", F.trim(F.array_join(F.transform("_b", lambda x: x["t"]), "")).alias("_body"))
    ids = F.when(F.col("status") == "answered", F.col("cited")).otherwise(F.col("nearest"))
    lead = F.when(F.col("status") == "answered", F.concat(F.lit("["), (F.col("_p") + 1).cast("string"), F.lit("] "))).otherwise("- ")
    each = answers.select("qid", "status", F.posexplode(ids).alias("_p", "id")).join(provisions.select("id", "path", "text"), "id")
    line = F.concat(lead, "id", F.lit(" — "), shown_path(F.col("path")), F.lit("\n    "), F.coalesce("text", F.lit("")))
    sources = each.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", line.alias("l")))), lambda x: x["l"]), "\n").alias("_s"))
    met = answers.join(body, "qid", "left").join(sources, "qid", "left")
    shown = F.concat(F.coalesce("_body", F.lit("")), F.lit("\n\nFontes (texto oficial):\n"), F.coalesce("_s", F.lit("")))
    why = F.concat(F.lit("Sem base no corpus: "), "message", F.coalesce(F.concat(F.lit("\n\nDispositivos mais próximos (texto oficial):\n"), "_s"), F.lit("")))
    return met.select("qid", F.when(F.col("status") == "answered", shown).otherwise(why).alias("text"))
