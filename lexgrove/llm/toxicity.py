"""Toxicity by cumulative-link ordinal regression.

P(grade > k | x) = sigmoid(w.x - theta_k) with theta_1 < theta_2: one weight vector for both ordered
thresholds. x has log(1 + rate) for a text's words and their prefixes of PREFIXES letters (languages that inflect or
compound), rate being the number in a hundred words. Fitting keeps those whose presence differs
between toxic and other labelled texts by more than chance (likelihood ratio).
Expected severity is the sum of the two probabilities, 0 to 2.

Grades: `labels` says only toxic or not. Grade 0 is not toxic; a toxic text is 2 if its share of
kept features is above the median of the toxic texts, else 1. So the lower threshold is learnt from
labels and P(toxic) is calibrated by them; the upper one is learnt from a rule on the model's own
features. P(severe), and with it severity, orders texts but is no calibrated probability.

Fitting takes at most FIT_ROWS labelled rows, those whose hash is least: a bounded sample. Their
features are counted by the executors; the driver gets the kept features and, for each row, those of
them that its text has. Scoring covers every whole text.

Nulls: a null or empty text has severity 0 by rule. A label row without doc_id, toxic or document
is passed over. Repeated label rows count as often as they stand there. Of documents with one doc_id
the one with the least text is learnt from, and each is scored. Without labels of both
kinds the model has no features and every text gets severity 0. An empty table gives an empty result.
Further columns are ignored by severities() and kept by clean().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import discard, id_text, table, texts, written

FIT_ROWS = 3_000
#: Least likelihood-ratio statistic of a kept word, and least number of documents with it.
LEAST_G2, LEAST_DOCS = 16.0, 3
REJECT_AT = 0.5
WORD = re.compile(r"[^\W\d_]+")


PREFIXES = (5, 6, 7)
#: Words whose features a worker remembers before it starts anew.
REMEMBERED = 500_000
#: A column of a feature and its count; rows of the fit that are weighed at once.
PAIRS, ROWS_AT_ONCE = np.dtype(">u4"), 256


def words(text: bytes) -> Counter:
    return Counter(WORD.findall(text.decode("utf-8", "replace").lower()))


def features(word: str) -> tuple[str, ...]:
    """The word itself, and its prefixes marked by a star."""
    return (word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k))


@dataclass
class OrdinalModel:
    """weights by feature, and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    theta: tuple[float, float] = (math.inf, math.inf)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def probabilities(self, text: bytes) -> tuple[float, float]:
        """P(grade >= 1), P(grade >= 2)."""
        if not self.weights or not text:
            return 0.0, 0.0
        counts, found = words(text), Counter()
        for w, n in counts.items():
            mine = self.known.get(w)
            if mine is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                mine = self.known[w] = tuple(f for f in features(w) if f in self.weights)
            for f in mine:
                found[f] += n
        per = 100 / max(1, sum(counts.values()))
        x = sum(self.weights[f] * math.log1p(n * per) for f, n in sorted(found.items()))
        return tuple(1 / (1 + math.exp(max(-700.0, min(700.0, t - x)))) for t in self.theta)


def g2(a: int, b: int, na: int, nb: int) -> float:
    """Likelihood ratio of a of na against b of nb, signed by which share is larger."""

    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n - k else 0.0)

    p = (a + b) / (na + nb)
    if p in (0, 1):
        return 0.0
    stat = 2 * (part(a, na, p) + part(b, nb, p))
    return stat if a * nb > b * na else -stat


def present(text: bytes) -> set[str]:
    return {f for w in words(text) for f in features(w)}


def marking(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, bool]:
    """Of features with their numbers of toxic and other texts, those kept, in order, and whether each marks toxic texts."""
    return {w: a * n0 > b * n1 for w, (a, b) in sorted(counts.items()) if a + b >= LEAST_DOCS and abs(g2(a, b, n1, n0)) >= LEAST_G2}


def counted(text: bytes, column: dict[str, int]) -> tuple[bytes, int]:
    """How often a text has each kept feature: their columns, in order, and counts as PAIRS; and its number of words."""
    all_words, found = words(text), Counter()
    for w, n in all_words.items():
        for f in features(w):
            if f in column:
                found[column[f]] += n
    return np.array(sorted(found.items()), PAIRS).tobytes(), max(1, sum(all_words.values()))


def fit_counts(rows: list[tuple[bytes, int, int]], kept: dict[str, bool], rounds: int = 60, ridge: float = 1e-4) -> OrdinalModel:
    """rows: a text's kept features as counted() packs them, its number of words, and whether it is toxic.

    Both thresholds share the rows of x. Newton steps, halved until the loss falls; x is the only large array.
    """
    k, marks = len(kept), np.array(list(kept.values()), bool)
    x, share = np.zeros((len(rows), k)), np.zeros(len(rows))
    for i, (found, size, _) in enumerate(rows):
        at, n = np.frombuffer(found, PAIRS).reshape(-1, 2).T.astype(np.int64)
        x[i, at] = np.log1p(100 * n / size)
        share[i] = n[marks[at]].sum() / size
    y = np.array([v for *_, v in rows])
    grade = np.where(y == 1, 1 + (share > np.median(share[y == 1])), 0)
    target = np.stack([grade > 0, grade > 1], 1).astype(float)
    penalty = ridge * len(x) * np.append(np.ones(k), [1e-6, 1e-6])
    sign = np.where(target > 0, -1, 1)
    margins = lambda v: (x @ v[:k])[:, None] - v[k:]
    loss = lambda v: np.logaddexp(0, sign * margins(v)).sum() + penalty @ (v * v) / 2
    v = np.zeros(k + 2)
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margins(v), -500, 500)))
        weight, missing = p * (1 - p) + 1e-9, target - p
        h = np.diag(penalty)
        for i in range(0, len(x), ROWS_AT_ONCE):
            part = x[i : i + ROWS_AT_ONCE]
            h[:k, :k] += (part * weight[i : i + ROWS_AT_ONCE].sum(1)[:, None]).T @ part
        h[:k, k:] = -(x.T @ weight)
        h[k:, :k] = h[:k, k:].T
        h[k:, k:] += np.diag(weight.sum(0))
        down = np.append(x.T @ missing.sum(1), -missing.sum(0)) - penalty * v
        step, t = np.linalg.solve(h, down), 1.0
        if down @ step <= 1e-9 * (1 + now):
            break
        while (then := loss(v + t * step)) > now - 1e-4 * t * (down @ step) and t > 1e-9:
            t /= 2
        v, now = v + t * step, then
    low, high = float(v[-2]), float(v[-1])
    return OrdinalModel({f: float(w) for f, w in zip(kept, v)}, (low, max(low, high)))


def fit_ordinal(rows: list[tuple[bytes, int]]) -> OrdinalModel:
    """rows: text and toxic. As fitted(), for texts at hand."""
    rows = [(t, int(y)) for t, y in rows if t]
    counts = (Counter(), Counter())
    for t, y in rows:
        counts[y].update(present(t))
    n1 = sum(y for _, y in rows)
    if not n1 or n1 == len(rows):
        return OrdinalModel()
    kept = marking({f: (counts[1][f], counts[0][f]) for f in counts[0].keys() | counts[1].keys()}, n1, len(rows) - n1)
    column = {f: i for i, f in enumerate(kept)}
    return fit_counts([(*counted(t, column), y) for t, y in rows], kept) if kept else OrdinalModel()


def presences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, y in zip(texts(batch), batch.column(1).to_pylist()):
            found = list(present(t))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["feature", "toxic"])


def counts_of(column: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [counted(t, column) for t in texts(batch)]
            found = pa.array([f for f, _ in each], pa.binary())
            yield pa.RecordBatch.from_arrays([found, pa.array([n for _, n in each], pa.int64()), batch.column(1)], names=["found", "size", "toxic"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits on at most `rows` labelled documents."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = labels.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id", "toxic").limit(rows).drop("_h")
    body = id_text(docs).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = written(body.where("text <> ''").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxic_sample")
    n1, n = found.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    model = OrdinalModel()
    if 0 < n1 < n:
        counts = found.mapInArrow(presences, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
        # What is below the least statistic stays away from the driver; marking() draws the line itself.
        kept = marking({r.feature: (r.a, r.n - r.a) for r in counts.where(g2_column(n1, n - n1) >= LEAST_G2 - 0.01).collect()}, n1, n - n1)
        if kept:
            column = {f: i for i, f in enumerate(kept)}
            each = found.mapInArrow(counts_of(column), "found binary, size long, toxic int").collect()
            # Packed as they are, bytes are in the order of the features and counts they stand for.
            model = fit_counts(sorted((bytes(r.found), r.size, r.toxic) for r in each), kept)
    discard(found)
    return model


def g2_column(n1: int, n0: int):
    """The size of g2() of the columns a (toxic texts) and n (texts) with a feature."""
    p = F.col("n") / F.lit(float(n1 + n0))

    def part(k, n: int):
        return F.when(k > 0, k * F.log(k / F.lit(float(n)) / p)).otherwise(0.0) + F.when(F.lit(n) - k > 0, (F.lit(n) - k) * F.log((F.lit(n) - k) / F.lit(float(n)) / (1 - p))).otherwise(0.0)

    return F.when((p > 0) & (p < 1), 2 * (part(F.col("a"), n1) + part(F.col("n") - F.col("a"), n0))).otherwise(0.0)


def scorer(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.probabilities(t) for t in texts(batch)]
            one, two = (pa.array([x[i] for x in p], pa.float64()) for i in (0, 1))
            severity = pa.array([sum(x) for x in p], pa.float64())
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, one, two, severity], names=[*names, "p_toxic", "p_severe", "severity"])

    return run


def severities(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, p_toxic, p_severe, severity (0 to 2), rejected."""
    scored = id_text(docs).mapInArrow(scorer(model), "doc_id long, p_toxic double, p_severe double, severity double")
    return scored.withColumn("rejected", F.col("p_toxic") >= REJECT_AT)


def keeper(model: OrdinalModel, at: float, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(column)
            filled = pa.RecordBatch.from_arrays([text.fill_null("")], names=["text"])
            yield batch.filter(pa.array([model.probabilities(t)[0] < at for t in texts(filled)], pa.bool_()))

    return run


def clean(docs: DataFrame, model: OrdinalModel, at: float = REJECT_AT) -> DataFrame:
    """docs without those whose P(toxic) is `at` or more; the same columns."""
    return docs.mapInArrow(keeper(model, at, docs.columns.index("text")), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severities(docs, fitted(docs, table(spark, sf_dir, "labels")))
