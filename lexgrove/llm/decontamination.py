"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, in lower case. A document is contaminated if 13 of its words in a
row stand against 13 words of a benchmark item with at most 3 of them replaced. An item of fewer words
counts as a whole: of 9 to 12 words with at most 2 replaced, of 8 with 1, of fewer with none.

Seeds are fixed masks that look at some word positions and ignore those between. For 13 words six masks
suffice: for any 3 of 13 positions there is a mask that fits into the window without looking at them
(tested), so no such overlap is missed. A short item is cut into one part more than words may be
replaced; each of its masks looks at one part, and one part is whole. Hashes of the masked words of
documents are looked up among those of the benchmark, and each hit is verified on the words around it,
by counting matches over all windows of its alignment.

The benchmark goes to the executors in lots of at most LOT_WORDS words and a piece: a benchmark of any
size is searched lot by lot against all documents, and an item of any length is cut into overlapping
pieces of PIECE words. The documents aren't shuffled. Places where one word is repeated are taken
together, so a text of one word costs its alignments, not all pairs of places.

Nulls: null and empty texts, of documents or items, hold no words and never match. A null doc_id or
item_id is kept. Repeated rows are each reported. An empty benchmark contaminates nothing; an empty
table gives an empty result. Further columns are ignored by matches() and kept by decontaminated().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import id_text, table, texts
from lexgrove.llm.near_dedup import mixed

WINDOW, REPLACED = 13, 3
MASKS = ("11010111", "1110010011", "1101111", "11010001101", "1111101", "111001011")
#: Words of a lot, which takes 112 bytes a word; words of a piece.
LOT_WORDS, PIECE = 1 << 20, 4_096
#: Hits that are turned into alignments at once.
HITS_AT_ONCE = 1 << 20
WORD = re.compile(r"[^\W_]+")
REMEMBERED = 300_000

_random = np.random.default_rng(13)
FACTORS = _random.integers(0, 1 << 63, max(WINDOW, max(map(len, MASKS))), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS = 22


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = WordHashes()


def word_hashes(text: bytes) -> np.ndarray:
    words = WORD.findall(text.decode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words a mask looks at, at each place where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            x += h[i : i + n] * FACTORS[i]
    return mixed(x)


def replaceable(size: int) -> int:
    """How many words of a window of an item may be replaced."""
    return REPLACED if size >= WINDOW else 2 if size >= 9 else 1 if size == 8 else 0


def masks_for(size: int) -> tuple[str, ...]:
    """The masks for items of so many words."""
    if size >= WINDOW:
        return MASKS
    parts = replaceable(size) + 1
    edges = [size * k // parts for k in range(parts + 1)]
    return tuple("0" * a + "1" * (b - a) + "0" * (size - b) for a, b in zip(edges, edges[1:]))


@dataclass
class Lot:
    """Items' words end to end, and for each mask the sorted seed hashes with their places."""

    words: np.ndarray
    item_of: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    masks: list[str]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    sieve: np.ndarray

    @staticmethod
    def of(items: list[np.ndarray]) -> Lot:
        sizes = np.array([len(h) for h in items], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        words = np.concatenate([*items, np.empty(0, np.uint64)])
        item_of = np.repeat(np.arange(len(items)), sizes)
        by_mask: dict[str, list[int]] = {}
        for k, h in enumerate(items):
            for mask in masks_for(len(h)) if len(h) else ():
                by_mask.setdefault(mask, []).append(k)
        hashes, places = [], []
        sieve = np.zeros(1 << FILTER_BITS, bool)
        for mask, own in by_mask.items():
            seeded = [seeds(items[k], mask) for k in own]
            x = np.concatenate(seeded)
            y = np.concatenate([np.arange(len(h)) + begins[k] for h, k in zip(seeded, own)])
            order = np.argsort(x, kind="stable")
            hashes.append(x[order])
            places.append(y[order])
            sieve[x >> np.uint64(64 - FILTER_BITS)] = True
        return Lot(words, item_of, begins, ends, list(by_mask), hashes, places, sieve)

    def alignments(self, h: np.ndarray) -> np.ndarray:
        """(item, shift of its first word in the document) of all seeds met, sorted."""
        spans = np.empty((0, 3), np.int64)
        for mask, known, places in zip(self.masks, self.hashes, self.places):
            x = seeds(h, mask)
            maybe = np.flatnonzero(self.sieve[x >> np.uint64(64 - FILTER_BITS)])
            if not len(maybe):
                continue
            # Neighbouring places with one hash are one hit, of shifts in a row.
            first = np.flatnonzero(np.append(True, (np.diff(maybe) != 1) | (x[maybe[1:]] != x[maybe[:-1]])))
            last = maybe[np.append(first[1:], len(maybe)) - 1]
            first = maybe[first]
            lo, hi = np.searchsorted(known, x[first]), np.searchsorted(known, x[first], "right")
            ends = np.cumsum(hi - lo)
            for done in range(0, int(ends[-1]), HITS_AT_ONCE):
                each = np.arange(done, min(done + HITS_AT_ONCE, int(ends[-1])))
                run = np.searchsorted(ends, each, "right")
                place = places[each - ends[run] + hi[run]]
                item = self.item_of[place]
                at = place - self.begins[item]
                spans = joined(np.concatenate([spans, np.stack([item, first[run] - at, last[run] - at], 1)]))
        if not len(spans):
            return np.empty((0, 2), np.int64)
        return np.concatenate([np.stack([np.full(b - a + 1, i), np.arange(a, b + 1)], 1) for i, a, b in spans])

    def overlaps(self, h: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, last word + 1, most matches in a window) of each alignment that counts."""
        out = []
        for item, shift in self.alignments(h).tolist():
            b, e = int(self.begins[item]), int(self.ends[item])
            first, last = max(0, shift), min(len(h), shift + e - b)
            size = min(WINDOW, e - b)
            if last - first < size:
                continue
            same = (h[first:last] == self.words[b + first - shift : b + last - shift]).astype(np.int64)
            total = np.cumsum(np.concatenate([[0], same]))
            windows = total[size:] - total[:-size]
            good = np.flatnonzero(windows >= size - replaceable(e - b))
            if len(good):
                out.append((item, first + int(good[0]), first + int(good[-1]) + size, int(windows.max())))
        return out


def joined(spans: np.ndarray) -> np.ndarray:
    """(item, first, last) of shifts, sorted, with what overlaps or touches made one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    if not len(spans):
        return spans
    # Shifts of one item never reach those of the next, as each item has a stretch of its own.
    base = spans[:, 0] * (1 << 40)
    reach = np.maximum.accumulate(base + spans[:, 2])
    new = np.append(True, base[1:] + spans[1:, 1] > reach[:-1] + 1)
    at = np.flatnonzero(new)
    last = reach[np.append(at[1:], len(spans)) - 1]
    return np.stack([spans[at, 0], spans[at, 1], last - base[at]], 1)


def lots(benchmark: DataFrame, most: int = LOT_WORDS) -> Iterator[tuple[list, Lot]]:
    """Item ids and their Lot, for pieces of items of about `most` words at a time; one partition of the benchmark is on the driver at once."""
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids, pieces, held = [], [], 0
    for r in items.toLocalIterator():
        h = word_hashes(r.text.encode("utf-8", "surrogatepass"))
        for i in range(0, max(1, len(h) - WINDOW + 1), PIECE):
            if len(h):
                ids.append(r.item_id)
                pieces.append(h[i : i + PIECE + WINDOW - 1])
                held += len(pieces[-1])
            if held >= most:
                yield ids, Lot.of(pieces)
                ids, pieces, held = [], [], 0
    if pieces:
        yield ids, Lot.of(pieces)


def searcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value
        for batch in batches:
            found = [lot.overlaps(word_hashes(t)) for t in texts(batch)]
            keep = pa.array([bool(f) for f in found])
            hits = [[{"item": i, "first": a, "last": b, "matches": m} for i, a, b, m in f] for f in found if f]
            kind = pa.list_(pa.struct([("item", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("matches", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(hits, kind)], names=["doc_id", "hits"])

    return run


HITS = "doc_id long, hits array<struct<item: long, first: long, last: long, matches: long>>"


def matches(docs: DataFrame, benchmark: DataFrame, most: int = LOT_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, last_word (exclusive), matches: an overlap of a document with an item, by alignment."""
    spark, docs, out = docs.sparkSession, id_text(docs), None
    for ids, lot in lots(benchmark, most):
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {dict(benchmark.dtypes)['item_id']}")
        hit = docs.mapInArrow(searcher(spark.sparkContext.broadcast(lot)), HITS).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
        part = hit.join(F.broadcast(names), "item").select("doc_id", "item_id", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "matches")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.limit(0).select("doc_id", F.lit(None).cast(dict(benchmark.dtypes)["item_id"]).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in ("first_word", "last_word", "matches")])
    return out


def flagger(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value
        for batch in batches:
            filled = pa.RecordBatch.from_arrays([batch.column(column).fill_null("")], names=["text"])
            yield batch.filter(pa.array([not lot.overlaps(word_hashes(t)) for t in texts(filled)], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, most: int = LOT_WORDS) -> DataFrame:
    """docs without the contaminated ones; the same columns. Lots filter one after another, without a shuffle."""
    for _, lot in lots(benchmark, most):
        docs = docs.mapInArrow(flagger(docs.sparkSession.sparkContext.broadcast(lot), docs.columns.index("text")), docs.schema)
    return docs


def op2_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_ids (sorted), n_items, contaminated: one row for each document."""
    hits = matches(docs, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = own.join(hits, own["doc_id"].eqNullSafe(hits["doc_id"]), "left").select(own["doc_id"], "item_ids")
    n = F.coalesce(F.size("item_ids"), F.lit(0))
    return out.select("doc_id", "item_ids", F.greatest(n, F.lit(0)).cast("long").alias("n_items"), (n > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_decontamination's pairs of documents and items, a row each: what SQL can be held against without lists."""
    found = op2_decontamination(spark, sf_dir).where("contaminated")
    return found.select("doc_id", F.explode("item_ids").alias("item_id"), "n_items")


#: Equal words of a document and an item, by alignment; of alignments with enough of them, every window that fits.
OVERLAPS_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS size, least(len(w), 13) AS span, least(len(w), 13) - CASE WHEN len(w) >= 13 THEN 3 WHEN len(w) >= 9 THEN 2 WHEN len(w) = 8 THEN 1 ELSE 0 END AS least FROM iw WHERE len(w) > 0),
d AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM dw),
b AS (SELECT item_id, size, span, least, unnest(w) AS word, unnest(range(len(w))) AS q FROM i),
c AS (SELECT doc_id, item_id, p - q AS shift, list(q) AS qs FROM d JOIN b USING (word) GROUP BY ALL HAVING count(*) >= any_value(least)),
f AS (SELECT doc_id, item_id, span, least, qs, unnest(range(greatest(0, -shift), least(size, len(dw.w) - shift) - span + 1)) AS s FROM c JOIN i USING (item_id) JOIN dw USING (doc_id)),
hit AS (SELECT DISTINCT doc_id, item_id FROM f WHERE len([q for q in qs if q >= s AND q < s + span]) >= least),
hits AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1)
SELECT doc_id, item_id, n AS n_items FROM hit JOIN hits USING (doc_id)
"""
