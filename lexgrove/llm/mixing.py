"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target share of the output divided by its share of the
input, times the output's size relative to the input's. A document is repeated as often as a
Poisson variable with that mean says; the variable comes from inverting its distribution at a
uniform number hashed from seed and doc_id, so reruns and lost tasks give the same copies. Copies
are dealt out in the order of a hash over the whole output. The sources' tables are broadcast once
their size has been counted, so whole rows are shuffled only once, into that order.

Production weights: each source counts with the square root of its documents (tempering), and the
output is as large as the input. A rate below 1 drops documents by chance: that is the method.

Nulls: documents without a source form a source of their own; a null doc_id draws as the text ''.
Rows with one doc_id draw one number, so repeated rows are repeated alike. A source with weight 0,
or without a weight where weights are given, gives nothing. Texts aren't read, so empty and long
ones behave alike. An empty table gives an empty result. Columns of docs called copy, n_copies or
shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.common import table, written

SEED = "mix-1"
#: Bytes of the sources' tables up to which they are broadcast; beyond, rows are joined by source in a shuffle.
BROADCAST = 32 << 20
OWN = ("copy", "n_copies", "shuffle_key")


def group_key():
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("none"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float = 1.0) -> DataFrame:
    """_group, rate: a row for each source. size: documents out per document in."""
    counted = docs.groupBy(group_key().alias("_group")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counted.withColumn("w", F.sqrt("n"))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("none" if k is None else f"={k}", float(v))])
        weighed = counted.withColumn("w", F.coalesce(given[F.col("_group")], F.lit(0.0)))
    all_n, all_w = weighed.agg(F.sum("n"), F.sum("w")).first()
    return weighed.select("_group", (F.col("w") / F.lit(float(all_w or 1)) * F.lit(float(all_n or 0) * size) / F.col("n")).alias("rate"))


def inverse_tables(rates: DataFrame) -> DataFrame:
    """_group, cdf: the Poisson distribution function at 0, 1, ... until it can't be told from 1."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    terms = rates.where("rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = W.partitionBy("_group").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    log_factorial = F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto)
    terms = terms.withColumn("p", F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial))
    terms = terms.withColumn("c", F.sum("p").over(upto))
    cdf = F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])
    return terms.groupBy("_group").agg(cdf.alias("cdf"))


def uniform(seed: str):
    """In [0, 1), from 48 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def replicated(docs: DataFrame, weights: dict[str | None, float] | None = None, size: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs, each row as often as drawn, with copy (from 0), n_copies and shuffle_key; in no order."""
    docs = docs.drop(*OWN)
    tables = written(inverse_tables(source_rates(docs, weights, size)), "poisson")
    held = tables.agg(F.coalesce(F.sum(F.octet_length("_group") + 8 * F.size("cdf") + 64), F.lit(0))).first()[0]
    drawn = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", group_key().alias("_group"), uniform(seed).alias("_u"))
    drawn = drawn.join(F.broadcast(tables) if held <= BROADCAST else tables.hint("merge"), "_group")
    n = F.size(F.filter("cdf", lambda c: c <= F.col("_u"))).cast("long")
    drawn = drawn.withColumn("n_copies", n).where("n_copies > 0").drop("cdf", "_group", "_u")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    mark = F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    return drawn.select("_row.*", "copy", "n_copies", F.md5(mark.cast("binary")).alias("shuffle_key"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The replicated documents in their shuffled order, which holds over all partitions."""
    rows = replicated(docs, **options)
    # Rows that repeat a doc_id have equal keys; a hash of all their columns puts them in an order that reruns keep.
    return rows.orderBy("shuffle_key", F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


OP8_SQL = f"""
WITH n AS (SELECT coalesce('=' || source, 'none') AS g, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT g, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
k AS (SELECT g, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM r WHERE rate > 0),
p AS (SELECT g, rate, k, exp(k * ln(rate) - rate - sum(ln(greatest(k, 1)::DOUBLE)) OVER (PARTITION BY g ORDER BY k)) AS p FROM k),
c AS (SELECT g, list(c ORDER BY k) AS cdf FROM (SELECT g, k, sum(p) OVER (PARTITION BY g ORDER BY k) AS c FROM p) GROUP BY g),
u AS (SELECT doc_id, source, coalesce('=' || source, 'none') AS g,
             ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {1 << 48} AS u FROM documents),
d AS (SELECT doc_id, source, len([x for x in cdf if x <= u])::BIGINT AS n_copies FROM u JOIN c USING (g)),
e AS (SELECT doc_id, source, n_copies, unnest(range(0, n_copies)) AS copy FROM d)
SELECT doc_id, source, copy::BIGINT AS copy, n_copies,
       md5('{SEED}/order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM e
"""
