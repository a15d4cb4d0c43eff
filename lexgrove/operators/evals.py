"""Evaluation aggregates (OP-A07 to A14, A18, E01 to E05, E14, J14)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.text import ancestors


#: Bytes of the texts that one automaton holds, about; a node takes up to 50 bytes for each.
LOT_BYTES = 4 << 20


def text_lots(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of items, in lots; one lot and one partition of the items are on the driver at a time."""
    ids, texts, held = [], [], 0
    for item, text in items.where("text <> ''").select("item_id", "text").toLocalIterator():
        ids.append(item)
        texts.append(text)
        held += len(text.encode())
        if held >= LOT_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def passages_in(items: DataFrame, docs: DataFrame) -> DataFrame:
    """OP-J14: item_id, doc_id: documents that hold an item's text verbatim; an item without text is in none.

    Each lot of texts goes to the executors as one automaton, which finds all of them, of any length, in one reading
    of each document. Documents aren't shuffled, only what is found.
    """
    spark = docs.sparkSession
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    out = None
    for ids, texts in text_lots(items):
        by_text: dict[str, list[int]] = {}
        for n, t in enumerate(texts):
            by_text.setdefault(t, []).append(n)
        shared = spark.sparkContext.broadcast(by_text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for t, numbers in shared.value.items():
                machine.add_word(t, numbers)
            machine.make_automaton()
            for batch in batches:
                at, found = [], []
                for d, text in enumerate(batch.column(1).to_pylist()):
                    own = sorted({n for _, numbers in machine.iter(text) for n in numbers})
                    at += [d] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["doc_id", "n"])

        met = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[1]}, n long").distinct()
        names = spark.createDataFrame(list(enumerate(ids)), f"n long, item_id {kinds[0]}")
        part = met.join(F.broadcast(names), "n").select("item_id", "doc_id")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kinds[0]}, doc_id {kinds[1]}") if out is None else out.distinct()


def percentiles_by(rows: DataFrame, split: str, value: str) -> DataFrame:
    """OP-A10, A18: nearest-rank percentiles of each split and of all, in one pass of grouping sets."""
    each = rows.select(F.col(split).alias("_s"), F.col(value).alias("_v"))
    out = each.groupingSets([[F.col("_s")], []], F.col("_s")).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by _v)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by _v)").alias("p95"))
    return out.select(F.coalesce("_s", F.lit("all")).alias("split"), "n", "p50", "p95")


def expected_ranks(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """item_id, id, rank (null: never found): where each expected id comes first. expected: item_id, id; ranked: item_id, id, rank from 1."""
    return expected.join(ranked.groupBy("item_id", "id").agg(F.min("rank").alias("rank")), ["item_id", "id"], "left")


def metrics_by_split(items: DataFrame, expected: DataFrame) -> DataFrame:
    """OP-A07 to A09, A18: split (and all), items, recall1, recall5, recall10, hit1, hit5, mrr.

    items: item_id, split. expected: a row for each expected id, with item_id and rank, as expected_ranks gives them. An
    item without expected ids has no recall, so the means of recall pass it over; it counts as not found in the others.
    """
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    each = expected.groupBy("item_id").agg(F.min("rank").alias("_first"), *[share(k).alias(f"_r{k}") for k in (1, 5, 10)])
    out = items.join(each, "item_id", "left").select(F.col("split").alias("_s"), "_first", "_r1", "_r5", "_r10").groupingSets([[F.col("_s")], []], F.col("_s"))
    recalls = [F.round(F.avg(f"_r{k}"), 6).alias(f"recall{k}") for k in (1, 5, 10)]
    hits = [F.round(F.avg(F.when(F.col("_first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}") for k in (1, 5)]
    out = out.agg(F.count("*").alias("items"), *recalls, *hits, F.round(F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"))
    return out.select(F.coalesce("_s", F.lit("all")).alias("split"), *out.columns[1:])


def evaluation(items: DataFrame, expected: DataFrame, ranked: DataFrame, refusals: DataFrame) -> DataFrame:
    """OP-E01 to E03, A13: split (and all), answerable, refuse, recall1, recall5, recall10, hit5, mrr, refusal_accuracy, false_refusal_rate.

    items: item_id, split, must_refuse. expected: item_id, id, of those that must be answered. ranked: item_id, id, rank
    from 1. refusals: item_id, refused (null: answered). A refused question shows nothing, so it ranks nothing. Means
    over no items are 0, but for the accuracy of refusals, which then is null. Rounded to four digits.
    """
    told = refusals.groupBy("item_id").agg(F.max(F.col("refused").isNotNull()).alias("_refused"))
    every = items.join(told, "item_id", "left").withColumn("_refused", F.coalesce("_refused", F.lit(False)))
    shown = ranked.join(every.where("not _refused and not must_refuse").select("item_id"), "item_id", "left_semi")
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    each = expected_ranks(expected.distinct(), shown).groupBy("item_id").agg(F.min("rank").alias("_first"), *[share(k).alias(f"_r{k}") for k in (1, 5, 10)])
    met = every.join(each, "item_id", "left").select(F.col("split").alias("_s"), "must_refuse", "_refused", "_first", "_r1", "_r5", "_r10")
    answer, refuse = ~F.col("must_refuse"), F.col("must_refuse")
    mean = lambda c, where: F.round(F.avg(F.when(where, c)), 4)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    or_zero = lambda c, where: F.coalesce(mean(F.coalesce(c, F.lit(0.0)), where), F.lit(0.0))
    out = met.groupingSets([[F.col("_s")], []], F.col("_s")).agg(
        F.count_if(answer).alias("answerable"),
        F.count_if(refuse).alias("refuse"),
        *[or_zero(F.col(f"_r{k}"), answer).alias(f"recall{k}") for k in (1, 5, 10)],
        or_zero(flag(F.col("_first") <= 5), answer).alias("hit5"),
        or_zero(1.0 / F.col("_first"), answer).alias("mrr"),
        mean(flag(F.col("_refused")), refuse).alias("refusal_accuracy"),
        or_zero(flag(F.col("_refused")), answer).alias("false_refusal_rate"),
    )
    return out.select(F.coalesce("_s", F.lit("all")).alias("split"), *out.columns[1:])


def generation_metrics(items: DataFrame) -> DataFrame:
    """OP-E05, A11, A14, A12: one row: answerable, answered_rate, citation_recall, must_refuse, refusal_accuracy, input_tokens, output_tokens, latency_p50, latency_p95.

    items: must_refuse, answered, recall (null: 0), input_tokens, output_tokens, latency. The median lies between the
    middle two; the 95th percentile is the latency at place floor(0.95 (n - 1)) from 0. Without items all are 0.
    """
    answer, zero = ~F.col("must_refuse"), F.lit(0.0)
    rate = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, c)), 6), zero)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = items.count()
    # The share at which percentile_disc() takes the value at that place.
    share = (int(0.95 * (n - 1)) + 0.5) / n if n else 0.5
    return items.agg(
        F.count_if(answer).alias("answerable"),
        rate(flag(F.col("answered")), answer).alias("answered_rate"),
        rate(F.when(F.col("answered"), F.coalesce("recall", zero)).otherwise(0.0), answer).alias("citation_recall"),
        F.count_if(~answer).alias("must_refuse"),
        rate(flag(~F.col("answered")), ~answer).alias("refusal_accuracy"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")],
        F.coalesce(F.expr("percentile(latency, 0.5)"), zero).alias("latency_p50"),
        F.coalesce(F.expr(f"percentile_disc({share!r}D) within group (order by latency)"), zero).alias("latency_p95"),
    )


def gate(rows: DataFrame, points: float) -> DataFrame:
    """OP-A20: config, dev, holdout, verdict: means by split, and if they differ by more than points."""
    out = rows.groupBy("config").pivot("split", ["dev", "holdout"]).agg(F.round(F.avg("value"), 6))
    return out.withColumn("verdict", F.when(F.abs(F.col("dev") - F.col("holdout")) > points, "differs").otherwise("alike"))


def best_setting(found: DataFrame, grid: DataFrame, names: list[str], score: Column, right: Column) -> DataFrame:
    """OP-J17, A19: the setting with the best mean reciprocal rank; ties go to the least setting.

    found: item_id, doc_id. grid, a small table made by rule, is broadcast.
    """
    order = W.partitionBy(*names, "item_id").orderBy(F.col("_score").desc(), "doc_id")
    ranked = found.join(F.broadcast(grid)).withColumn("_score", score).withColumn("_rank", F.row_number().over(order))
    first = ranked.groupBy(*names, "item_id").agg(F.min(F.when(right, F.col("_rank"))).alias("_first"))
    each = first.groupBy(*names).agg(F.round(F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"))
    return each.orderBy(F.col("mrr").desc(), *names).limit(1)


def citation_recall(cited: DataFrame, expected: DataFrame) -> DataFrame:
    """OP-J12, A14, E14: qid, expected, met, recall: the share of a question's expected ids that a cited id is, contains, or lies in.

    cited, expected: qid, id; repeats count once. Each side's ancestors meet the other's ids: two equi-joins, no prefix comparison.
    """
    own, sought = cited.select("qid", "id").distinct(), expected.select("qid", "id").distinct()
    up = lambda df, name: df.withColumnRenamed("id", name).select("qid", name, F.explode(ancestors(F.col(name))).alias("_k"))
    below = up(sought, "id").join(own.withColumnRenamed("id", "_k"), ["qid", "_k"]).select("qid", "id")
    above = sought.join(up(own, "_c").select("qid", F.col("_k").alias("id")), ["qid", "id"]).select("qid", "id")
    met = below.unionByName(above).distinct().withColumn("_met", F.lit(1))
    out = sought.join(met, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("expected"), F.count("_met").alias("met"))
    return out.withColumn("recall", F.round(F.col("met") / F.col("expected"), 6))


def pass_rates(results: DataFrame) -> DataFrame:
    """OP-A15: check, passed, failed, skipped, pass_rate: of those that ran, 0 if none did. results: check, outcome."""
    counts = results.groupBy("check").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped")])
    ran = F.col("passed") + F.col("failed")
    return counts.withColumn("pass_rate", F.when(ran > 0, F.col("passed") / ran).otherwise(0.0))


def score_floor(scores: DataFrame) -> DataFrame:
    """OP-A23: one row, least and p05: the least score, and the one at place n // 20 from 0. Nulls without scores."""
    n = scores.where("score is not null").count()
    share = (n // 20 + 0.5) / n if n else 0.5
    return scores.agg(F.min("score").alias("least"), F.expr(f"percentile_disc({share!r}D) within group (order by score)").alias("p05"))


def missed(items: DataFrame, expected: DataFrame, ranked: DataFrame, refusals: DataFrame, within: int = 5) -> DataFrame:
    """OP-F12: item_id, problem: answered (must be refused, but wasn't), refused (must be answered), or missed (nothing expected within the first ranks)."""
    told = refusals.groupBy("item_id").agg(F.max("refused").alias("_refused"))
    first = expected_ranks(expected.distinct(), ranked).groupBy("item_id").agg(F.min("rank").alias("_first"))
    met = items.join(told, "item_id", "left").join(first, "item_id", "left")
    problem = (
        F.when(F.col("must_refuse") & F.col("_refused").isNull(), "answered")
        .when(~F.col("must_refuse") & F.col("_refused").isNotNull(), "refused")
        .when(~F.col("must_refuse") & (F.col("_first").isNull() | (F.col("_first") > within)), "missed")
    )
    return met.select("item_id", problem.alias("problem")).where("problem is not null")
