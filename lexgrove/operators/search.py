"""Retrieval for a batch of questions (OP-R02 to R17, J02, J05, J07, T01, T02, X02, F09).

Lexical scores are made in the scan: the terms of a lot of questions go to the executors (a lot is bounded, a
batch of any size is searched lot by lot), a document's tokens meet them in its own row, and each task passes on
only its n best documents of a question. No token is shuffled. The analyzer is tokens(): no stems, no stop words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions.text import or_terms, tokens

#: Questions of a lot, and their terms in all: the executors hold a table of one by the other, a byte each.
LOT_QUESTIONS, LOT_TERMS = 512, 50_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, t: each document's tokens in order. A null text has none."""
    return docs.select(F.col(key).alias("id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))


@dataclass
class Lot:
    """Questions, the numbers of their terms, and which question has which term."""

    qids: list
    numbers: dict[str, int]
    has: np.ndarray  # terms x questions

    @staticmethod
    def of(rows: list[tuple]) -> Lot:
        numbers: dict[str, int] = {}
        pairs = [(numbers.setdefault(t, len(numbers)), q) for q, (_, terms) in enumerate(rows) for t in terms]
        has = np.zeros((len(numbers), len(rows)), bool)
        for t, q in pairs:
            has[t, q] = True
        return Lot([q for q, _ in rows], numbers, has)


def lots(questions: DataFrame, key: str, text: str) -> Iterator[Lot]:
    """Only one lot and one partition of the questions are on the driver at a time."""
    rows, held = [], 0
    for qid, terms in questions.select(F.col(key), or_terms(F.col(text))).toLocalIterator():
        if terms and (len(rows) >= LOT_QUESTIONS or held + len(terms) > LOT_TERMS):
            yield Lot.of(rows)
            rows, held = [], 0
        if terms:
            rows.append((qid, terms))
            held += len(terms)
    if rows:
        yield Lot.of(rows)


class Batch:
    """Documents' tokens as numbers of a lot's terms: of those that are any, document, place and term; and each document's number of tokens."""

    def __init__(self, column: pa.ListArray, vocabulary: pa.Array) -> None:
        self.column = column
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(self.sizes) - self.sizes
        found = pc.fill_null(pc.index_in(column.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(found >= 0)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[at]
        self.place, self.term = at - begins[self.doc], found[at].astype(np.int64)
        self.edges = np.searchsorted(self.doc, np.arange(len(self.sizes) + 1))

    def documents(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each document that has a term: its row, the places of its terms, and the terms."""
        for d in np.flatnonzero(np.diff(self.edges)).tolist():
            own = slice(self.edges[d], self.edges[d + 1])
            yield d, self.place[own], self.term[own]

    def different(self, d: int) -> int:
        return len(set(self.column[d].as_py()))


class Best:
    """The n best documents of each question so far; ties by id."""

    def __init__(self, questions: int, n: int) -> None:
        self.n, self.held = n, [(np.empty(0), [])] * questions

    def add(self, scores: np.ndarray, ids: list) -> None:
        """scores: documents x questions, NaN where they don't meet."""
        for q in range(scores.shape[1]):
            met = np.flatnonzero(~np.isnan(scores[:, q]))
            if not len(met):
                continue
            own = scores[met, q]
            if len(met) > self.n:
                near = own >= np.partition(own, len(own) - self.n)[len(own) - self.n]
                met, own = met[near], own[near]
            old, names = self.held[q]
            every, names = np.concatenate([old, own]), names + [ids[i] for i in met]
            order = sorted(range(len(names)), key=lambda i: (-every[i], names[i]))[: self.n]
            self.held[q] = every[order], [names[i] for i in order]

    def rows(self, qids: list) -> list[tuple]:
        return [(qid, i, float(x)) for qid, (scores, ids) in zip(qids, self.held) for x, i in zip(scores, ids)]


def best_in_scan(questions: DataFrame, posted: DataFrame, n: int, scorer: Callable, key: str, text: str) -> DataFrame:
    """qid, id, score: what may be among a question's n best.

    scorer(lot): a function of the lot and a Batch that yields rows of the batch with their scores by question, NaN where they share no term.
    """
    spark, kinds = posted.sparkSession, (questions.schema[key].dataType, posted.schema["id"].dataType)
    schema = f"qid {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"
    rows = posted.select("id", "t").where("id is not null")
    out = None
    for lot in lots(questions, key, text):
        shared, score = spark.sparkContext.broadcast(lot), scorer(lot)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, score=score) -> Iterator[pa.RecordBatch]:
            lot = shared.value
            best, vocabulary, kind = Best(len(lot.qids), n), pa.array(list(lot.numbers), pa.string()), pa.null()
            for batch in batches:
                kind = batch.schema.field(0).type
                met = list(score(lot, Batch(batch.column(1), vocabulary)))
                if met:
                    best.add(np.array([x for _, x in met]), batch.column(0).take(pa.array([d for d, _ in met])).to_pylist())
            found = best.rows(lot.qids)
            if found:
                q, i, x = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i, kind), pa.array(x, pa.float64())], names=["qid", "id", "score"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def top(scored: DataFrame, n: int) -> DataFrame:
    """OP-T01, W01: the n best of each question, ties by id; rank from 1."""
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def density(flag: int) -> Callable:
    """The scorer of cover_density()."""

    def score(lot: Lot, batch: Batch) -> Iterator[tuple[int, np.ndarray]]:
        by_question = np.ascontiguousarray(lot.has.T)
        for d, place, term in batch.documents():
            terms, tf = np.unique(term, return_counts=True)
            n, size = tf @ lot.has[terms].astype(np.float64), int(batch.sizes[d])
            out = 0.1 * n
            if flag & 4:
                q, k = np.nonzero(by_question[:, term])
                follows = q[1:] == q[:-1]
                near = np.bincount(q[1:][follows], weights=1.0 / np.diff(place[k])[follows], minlength=len(n))
                out = np.where(n < 2, out, out * near / np.maximum(n, 1))
            if flag & 1:
                out = out / (1 + np.log(size))
            if flag & 2:
                out = out / size
            if flag & 8:
                out = out / batch.different(d)
            if flag & 16:
                out = out / (1 + np.log(batch.different(d)))
            if flag & 32:
                out = out / (out + 1)
            yield d, np.where(n > 0, np.round(out, 6), np.nan)

    return lambda lot: score


def cover_density(questions: DataFrame, posted: DataFrame, flag: int, n: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """OP-R03: qid, id, score, rank: a question's n best documents.

    flag: a bit mask. 1: by log length; 2: by length; 4: by mean harmonic distance; 8: by different words; 16: by their log; 32: r / (r + 1).
    """
    return top(best_in_scan(questions, posted, n, density(flag), key, text), n)


def corpus_counts(posted: DataFrame, lot: Lot) -> tuple[int, float, np.ndarray]:
    """Documents with tokens, their mean number of tokens, and for each term of the lot how many have it. Tasks count on their own; a row for each term that any has met comes to the driver."""
    shared = posted.sparkSession.sparkContext.broadcast(list(lot.numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.string())
        # The last two: documents, and tokens.
        n = np.zeros(len(vocabulary) + 2, np.int64)
        for batch in batches:
            own = Batch(batch.column(0), vocabulary)
            n[:-2] += np.bincount(np.unique(own.doc * len(vocabulary) + own.term) % len(vocabulary), minlength=len(vocabulary))
            n[-2:] += int((own.sizes > 0).sum()), int(own.sizes.sum())
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["k", "n"])

    n = np.zeros(len(lot.numbers) + 2, np.int64)
    for r in posted.select("t").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        n[r.k] = r.n
    return int(n[-2]), n[-1] / max(1, n[-2]), n[:-2]


def bm25(questions: DataFrame, posted: DataFrame, n: int, k1: float = 1.2, b: float = 0.75, key: str = "item_id", text: str = "text") -> DataFrame:
    """qid, id, score, rank: a question's n best documents. Counts over all documents come from one pass before."""

    def scorer(lot: Lot) -> Callable:
        docs, mean, df = corpus_counts(posted, lot)
        idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))

        def score(lot: Lot, batch: Batch) -> Iterator[tuple[int, np.ndarray]]:
            weights = lot.has * idf[:, None]
            for d, _, term in batch.documents():
                terms, tf = np.unique(term, return_counts=True)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * int(batch.sizes[d]) / mean))
                yield d, np.where(lot.has[terms].any(0), np.round(part @ weights[terms], 6), np.nan)

        return score

    return top(best_in_scan(questions, posted, n, scorer, key, text), n)


BLOCK = 1024


def packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """ids, flat: rows in blocks of at most BLOCK, sorted by id within, without a shuffle. Rows without a vector go."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK].sort_values("id", kind="stable")
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "flat": [np.concatenate(part["v"].to_numpy())]})

    slim = rows.where(F.size(vector) > 0).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return slim.mapInPandas(run, f"ids array<{kind}>, flat array<double>")


def unit(ids, flat) -> np.ndarray:
    m = np.asarray(flat).reshape(len(ids), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def dense_topk(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """OP-R04, T02: qid, id, score, rank: exact cosine of every query (qid, q) with every vector (id, v), the n best; ties by id.

    Blocks of queries meet blocks of vectors, and each meeting passes on only n rows a query. Spark broadcasts
    the query blocks if their size allows it and pairs the blocks' partitions otherwise. A zero vector scores 0.
    """
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for vids, v, qids, q in batch.itertuples(index=False):
                scores = np.round(unit(qids, q) @ unit(vids, v).T, 6)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"qid": np.repeat(qids, best.shape[1]), "id": np.asarray(vids)[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})

    asked = packed(queries, "qid", "q").select(F.col("ids").alias("qids"), F.col("flat").alias("q"))
    met = packed(vectors, "id", "v").crossJoin(asked)
    return top(met.mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, score double"), n)


#: Vectors that lists are fitted on: a bounded sample, those whose id's hash is least. Rounds of the fit.
FIT_VECTORS, ROUNDS = 20_000, 12


def fit_lists(vectors: DataFrame, lists: int) -> np.ndarray:
    """Unit centres of `lists` lists, by spherical k-means on at most FIT_VECTORS of the vectors (id, v)."""
    sample = vectors.where(F.size("v") > 0).select("id", F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(FIT_VECTORS)
    rows = sample.collect()
    if not rows:
        return np.zeros((0, 0))
    m = unit(rows, np.concatenate([r.v for r in rows]))
    centres = m[np.linspace(0, len(m) - 1, min(lists, len(m))).astype(int)]
    for _ in range(ROUNDS):
        near = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        filled = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(filled[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), centres)
    return centres


def ann_index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """OP-R05: id, v, list: every vector with its nearest centre. Kept as a table partitioned by list, a search reads only the lists it probes."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = (unit(batch, np.concatenate(batch["v"].to_numpy())) @ shared.value.T).argmax(1)
                yield batch.assign(list=near.astype(np.int32))

    return vectors.where(F.size("v") > 0).select("id", F.col("v").cast("array<double>").alias("v")).mapInPandas(run, f"id {kind}, v array<double>, list int")


def ann_topk(queries: DataFrame, index: DataFrame, centres: np.ndarray, n: int, probes: int) -> DataFrame:
    """OP-R05: qid, id, score, rank: the n best by exact cosine among the vectors of a query's `probes` nearest lists; ties by id.

    Lots of at most LOT_QUESTIONS queries are broadcast; vectors aren't shuffled, only each task's best. With as many probes as
    lists the result is that of dense_topk().
    """
    spark, kinds = index.sparkSession, (queries.schema["qid"].dataType.simpleString(), index.schema["id"].dataType.simpleString())
    out, rows = None, []

    def search(rows: list) -> DataFrame:
        q = unit(rows, np.concatenate([r.q for r in rows]))
        probed = np.zeros((len(rows), len(centres)), bool)
        np.put_along_axis(probed, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, 1)
        shared = spark.sparkContext.broadcast(([r.qid for r in rows], q, probed))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, q, probed = shared.value
            best = Best(len(qids), n)
            for batch in batches:
                if len(batch):
                    scores = np.round(unit(batch, np.concatenate(batch["v"].to_numpy())) @ q.T, 6)
                    best.add(np.where(probed.T[batch["list"].to_numpy()], scores, np.nan), batch["id"].tolist())
            yield pd.DataFrame(best.rows(qids), columns=["qid", "id", "score"])

        wanted = [int(k) for k in np.flatnonzero(probed.any(0))]
        return index.where(F.col("list").isin(wanted)).mapInPandas(run, f"qid {kinds[0]}, id {kinds[1]}, score double")

    for r in queries.where(F.size("q") > 0).select("qid", F.col("q").cast("array<double>").alias("q")).toLocalIterator():
        rows.append(r)
        if len(rows) == LOT_QUESTIONS:
            out = search(rows) if out is None else out.unionByName(search(rows))
            rows = []
    if rows and len(centres):
        out = search(rows) if out is None else out.unionByName(search(rows))
    return top(spark.createDataFrame([], f"qid {kinds[0]}, id {kinds[1]}, score double") if out is None else out, n)


def rrf(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """OP-R12: qid, id, score, best: weighted reciprocal ranks of lists (qid, id, rank); ties by best rank, then id."""
    if k <= 0:
        raise ValueError("k must be positive")
    out = None
    for ranking, weight in rankings:
        # A list that names a document twice counts its first rank.
        part = ranking.groupBy("qid", "id").agg(F.min("rank").alias("rank")).withColumn("w", F.lit(float(weight)))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 6).alias("score"), F.min("rank").alias("best"))


def first_existing(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """OP-J05: of each row's array of candidate ids, the first that exists; missing names the last when none does."""
    each = candidates.select("rid", F.posexplode("ids").alias("pos", "id"))
    met = each.join(known.select("id").distinct(), "id").groupBy("rid").agg(F.min_by("id", "pos").alias("found"))
    return candidates.join(met, "rid", "left").select("rid", "found", F.when(F.col("found").isNull(), F.element_at("ids", -1)).alias("missing"))


def refusal(summary: DataFrame, threshold: float | None) -> DataFrame:
    """OP-F09: explicit answers are never refused; then a missing reference, a foreign act, a low score.

    summary: explicit, missing and foreign as counts, and best, the question's best similarity. Without a threshold no score is low.
    """
    low = F.lit(False) if threshold is None else F.col("best").isNull() | (F.col("best") < threshold)
    reason = (
        F.when(F.col("explicit") > 0, None)
        .when(F.col("missing") > 0, "nonexistent_provision")
        .when(F.col("foreign") > 0, "out_of_scope")
        .when(low, "low_score")
    )
    return summary.withColumn("refused", reason)


def overlap(questions: DataFrame, posted: DataFrame, head: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """OP-R15's deterministic scorer: qid, id, score (how many of a question's terms a document has), for the rows of head only."""
    asked = questions.select(F.col(key).alias("qid"), or_terms(F.col(text)).alias("_q"))
    met = posted.join(head.select("qid", "id"), "id").join(asked, "qid")
    return met.select("qid", "id", F.size(F.array_intersect("_q", "t")).cast("long").alias("score")).where("score > 0")


def blend(original: DataFrame, reranked: DataFrame, k: int = 60) -> DataFrame:
    """OP-R14, R16: qid, id, score, rank: equal-weight reciprocal ranks of what both have; ties keep the original order."""
    met = original.select("qid", "id", F.col("rank").alias("_a")).join(reranked.select("qid", "id", F.col("rank").alias("_b")), ["qid", "id"])
    scored = met.withColumn("score", F.round(1.0 / (k + F.col("_a")) + 1.0 / (k + F.col("_b")), 6))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "_a"))).drop("_a", "_b")


def explicit_first(explicit: DataFrame, fused: DataFrame, n: int) -> DataFrame:
    """OP-X02: qid, id, score, rank: what a question names (qid, id) at score 1.0, by id, then fused hits (qid, id, rank, score); each id once."""
    named = explicit.select("qid", "id", F.lit(0).alias("_turn"), F.lit(0).alias("_at"), F.lit(1.0).alias("score"))
    rest = fused.select("qid", "id", F.lit(1).alias("_turn"), F.col("rank").alias("_at"), "score")
    first = named.unionByName(rest).groupBy("qid", "id").agg(F.min(F.struct("_turn", "_at", "score")).alias("_f"))
    order = W.partitionBy("qid").orderBy("_f._turn", "_f._at", "id")
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("qid", "id", F.col("_f.score").alias("score"), "rank")
