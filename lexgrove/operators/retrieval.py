"""Search of a batch of questions over an index of provisions (OP-R01 to R21, J03, J04, J11, F05, F09, A04).

Everything is a join on identifiers: a question's references, its lexical and its dense hits meet in one
plan, whatever the number of questions. Null questions find nothing. Ties go by rank, then identifier.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.functions.embedding import hashing_embed
from lexgrove.functions.grammar import find_references, other_acts
from lexgrove.operators import search as S

LONGEST_ANCESTOR = 300


@dataclass(frozen=True)
class Tuning:
    normalization: int = 4
    lexical_weight: float = 0.5
    dense_weight: float = 1.0
    parent_weight: float = 0.2
    pool: int = 50
    depth: int = 10
    k: int = 8
    threshold: float | None = 0.4


@dataclass(frozen=True)
class Index:
    provisions: DataFrame  # id, text, revoked, vetoed, ...
    chunks: DataFrame  # id, content
    posted: DataFrame  # S.postings of chunks
    vectors: DataFrame  # id, v
    embed: Callable[[Column], Column]


def provision_ancestors(c: Column) -> Column:
    """The provisions above a provision, outermost first: acts and annexes aren't any."""
    return F.filter(T.above(c), lambda a: F.contains(a, F.lit(":art")))


def chunks(provisions: DataFrame, names: DataFrame) -> DataFrame:
    """OP-R21, J11: id, content: act and path, ancestors' texts clipped, own text; of what is in force and has a text.

    names: document_id, short_name. An act without a name goes by its identifier.
    """
    own = provisions.where("not revoked and not vetoed and text <> ''").select("id", "document_id", "path", "text")
    up = own.select("id", F.posexplode(provision_ancestors(F.col("id"))).alias("_n", "_a"))
    texts = provisions.where("text <> ''").select(F.col("id").alias("_a"), T.clip(F.col("text"), LONGEST_ANCESTOR).alias("_t"))
    above = up.join(texts, "_a").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]).alias("_above"))
    met = own.join(above, "id", "left").join(names.select("document_id", "short_name"), "document_id", "left")
    head = F.array_join(F.concat(F.array(F.coalesce("short_name", "document_id")), F.coalesce("path", F.array().cast("array<string>"))), " > ")
    return met.select("id", F.array_join(F.concat(F.array(head), F.coalesce("_above", F.array().cast("array<string>")), F.array("text")), "\n").alias("content"))


#: Characters of a question (by default, and at most), and hits that may be asked for.
LONGEST_QUESTION, HARD_LIMIT, MOST_HITS = 2_000, 20_000, 20


def input_problem(question: Column, k: Column, longest: int = LONGEST_QUESTION) -> Column:
    """OP-F08: empty, too_long, or bad_k; null if a question may be searched. A null k is the default."""
    n = F.length(F.coalesce(question, F.lit("")))
    return F.when(n < 1, "empty").when(n > min(longest, HARD_LIMIT), "too_long").when(k.isNotNull() & ~k.between(1, MOST_HITS), "bad_k")


def lookup(provisions: DataFrame, ids: DataFrame) -> DataFrame:
    """OP-F01 to F03, J01: the provisions that ids (id; repeats count once) name, with normative: neither revoked nor vetoed."""
    return provisions.join(ids.select("id"), "id", "left_semi").withColumn("normative", ~F.col("revoked") & ~F.col("vetoed"))


def in_force_counts(provisions: DataFrame) -> DataFrame:
    """OP-A22: document_id, provisions, in_force."""
    return provisions.groupBy("document_id").agg(F.count("*").alias("provisions"), F.count_if(~F.col("revoked") & ~F.col("vetoed")).alias("in_force"))


def holding_all(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """OP-F10: the rows whose column holds every word, accents and case aside. A null column holds none."""
    text = T.fold(F.col(column))
    return rows.where(F.forall(F.array(*[T.fold(F.lit(w)) for w in words]), lambda w: F.contains(text, w)))


def build_index(provisions: DataFrame, names: DataFrame, dimension: int = 256) -> Index:
    embed = lambda c: hashing_embed(c, dimension)
    made = chunks(provisions, names)
    return Index(provisions, made, S.postings(made, "id", "content"), made.select("id", embed(F.col("content")).alias("v")), embed)


def named(questions: DataFrame, provisions: DataFrame) -> DataFrame:
    """OP-J05, R18 to R20: qid, acts, explicit (ids in force, in order), missing (references without a provision).

    A question about an act outside the corpus has no references.
    """
    asked = questions.select("qid", other_acts(F.col("text")).alias("acts"), find_references(F.col("text")).alias("_r"))
    each = asked.where("size(acts) = 0").select("qid", F.posexplode("_r").alias("_g", "_ids"))
    one = each.select("qid", "_g", F.element_at("_ids", -1).alias("_last"), F.posexplode("_ids").alias("_n", "id"))
    known = provisions.select("id", (~F.col("revoked") & ~F.col("vetoed")).alias("_force"))
    best = one.join(known, "id", "left").groupBy("qid", "_g").agg(F.min(F.when(F.col("_force").isNotNull(), F.struct("_n", "id", "_force"))).alias("_f"), F.first("_last").alias("_last"))
    lists = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("_f._force"), F.struct("_g", F.col("_f.id").alias("id"))))).alias("_e"),
        F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.struct("_g", F.col("_last").alias("id"))))).alias("_m"),
    )
    empty = F.array().cast("array<string>")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["id"]), empty)
    return asked.select("qid", "acts").join(lists, "qid", "left").select("qid", "acts", F.array_distinct(ids("_e")).alias("explicit"), ids("_m").alias("missing"))


def propagate(fused: DataFrame, known: DataFrame, weight: float) -> DataFrame:
    """OP-R13, A06, T04: qid, id, score, rank: each ancestor also gets weight ** depth of an item's own score.

    fused: qid, id, score, rank. known: id, the provisions there are. Ties keep the input's order; new ancestors come as found.
    """
    up = provision_ancestors(F.col("id"))
    above = fused.select("qid", "score", "rank", F.size(up).alias("_s"), F.posexplode(up).alias("_n", "id")).withColumn("_d", F.col("_s") - F.col("_n"))
    given = above.join(known.select("id").distinct(), "id", "left_semi").select("qid", "id", (F.col("score") * F.pow(F.lit(weight), F.col("_d"))).alias("score"), (F.lit(1_000_000) + F.col("rank") * 10 + F.col("_d")).alias("_o"))
    own = fused.select("qid", "id", "score", F.col("rank").alias("_o"))
    total = own.unionByName(given).groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("score"), F.min("_o").alias("_o"))
    return total.select("qid", "id", "score", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "_o", "id")).alias("rank"))


def shared_terms(pairs: DataFrame) -> DataFrame:
    """OP-R15's stand-in for a neural scorer: qid, id, question, content, score (the question's terms in the content)."""
    return pairs.withColumn("score", F.size(F.array_intersect(T.or_terms(F.col("question")), T.tokens(F.col("content")))).cast("double"))


def rerank(ranked: DataFrame, questions: DataFrame, made: DataFrame, scorer: Callable[[DataFrame], DataFrame], depth: int) -> DataFrame:
    """OP-R16, T07: ranked (qid, id, score, rank, explicit) with the first depth in the blend of both orders.

    Explicit hits stay first, then the blend, then what has no content (score 0), then the rest at 1 / (60 + rank).
    """
    head = ranked.where((F.col("rank") <= depth) & ~F.col("explicit"))
    first = head.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("rank")).alias("rank"))
    pairs = first.join(made, "id").join(questions.select("qid", F.col("text").alias("question")), "qid").select("qid", "id", "question", "content")
    scored = scorer(pairs).select("qid", "id", "score").join(first, ["qid", "id"])
    second = scored.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "rank")).alias("rank"))
    blended = S.blend(first, second).select("qid", "id", F.col("score").alias("_s"), F.col("rank").alias("_b"))
    turn = F.when(F.col("explicit") & (F.col("rank") <= depth), 0).when(F.col("_b").isNotNull(), 1).when(F.col("rank") <= depth, 2).otherwise(3)
    met = ranked.join(blended, ["qid", "id"], "left").withColumn("_t", turn)
    met = met.withColumn("_p", F.row_number().over(W.partitionBy("qid").orderBy("_t", "_b", "rank")))
    score = F.when(F.col("_t") == 1, F.col("_s")).when(F.col("_t") == 2, 0.0).when(F.col("_t") == 3, F.round(1.0 / (60 + F.col("_p")), 6)).otherwise(F.col("score"))
    return met.select("qid", "id", score.alias("score"), F.col("_p").alias("rank"), "explicit")


def search(questions: DataFrame, index: Index, tuning: Tuning = Tuning(), mode: str = "hybrid", scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """OP-R17: hits (qid, id, score, rank, explicit) and a summary (qid, best, explicit, missing, acts, refused).

    questions: qid (each once), text. mode: hybrid, lexical or dense. Without a threshold no low score is refused.
    """
    if mode not in ("hybrid", "lexical", "dense"):
        raise ValueError(f"no such mode: {mode}")
    lists, best = [], None
    if mode != "dense":
        lists.append((S.cover_density(questions, index.posted, tuning.normalization, tuning.pool, "qid"), tuning.lexical_weight))
    if mode != "lexical":
        dense = S.dense_topk(questions.where("text is not null").select("qid", index.embed(F.col("text")).alias("q")), index.vectors, tuning.pool)
        lists.append((dense, tuning.dense_weight))
        best = dense.groupBy("qid").agg(F.max("score").alias("best"))
    fused = S.rrf(lists)
    fused = fused.select("qid", "id", "score", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "best", "id")).alias("rank"))
    if tuning.parent_weight:
        fused = propagate(fused, index.provisions, tuning.parent_weight)
    refs = named(questions, index.provisions)
    told = refs.select("qid", F.posexplode("explicit").alias("_n", "id")).select("qid", "id", F.lit(1.0).alias("score"), F.col("_n").alias("_o"), F.lit(0).alias("_t"))
    both = told.unionByName(fused.select("qid", "id", "score", F.col("rank").alias("_o"), F.lit(1).alias("_t")))
    once = both.groupBy("qid", "id").agg(F.min(F.struct("_t", "_o", "score")).alias("_f"))
    ranked = once.select("qid", "id", F.col("_f.score").alias("score"), F.row_number().over(W.partitionBy("qid").orderBy("_f._t", "_f._o", "id")).alias("rank"), (F.col("_f._t") == 0).alias("explicit"))
    if scorer and tuning.depth:
        ranked = rerank(ranked, questions, index.chunks, scorer, tuning.depth)
    hits = ranked.where(F.col("rank") <= tuning.k).join(index.provisions.select("id").distinct(), "id", "left_semi").select("qid", "id", "score", "rank", "explicit")
    summary = refs.join(best, "qid", "left") if best is not None else refs.withColumn("best", F.lit(None).cast("double"))
    lists = {"explicit": "_explicit", "missing": "_missing", "acts": "_foreign"}
    counted = summary.withColumnsRenamed(lists).select("qid", "best", *lists.values(), *[F.size(c).alias(c[1:]) for c in lists.values()])
    told = S.refusal(counted, tuning.threshold).select("qid", "best", *lists.values(), "refused")
    return hits, told.withColumnsRenamed({v: k for k, v in lists.items()})
