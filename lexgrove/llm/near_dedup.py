"""Near deduplication by b-bit MinHash.

Documents are sets of hashed 5-word shingles. Copies of one set are one representative from here on.
192 minima in 48 bands of 4 find candidates (a pair at the threshold is missed with a chance of
1e-8); of each minimum the lowest 4 bits are packed in bit planes, and a candidate's similarity is
estimated from the bit count of the planes' differences, corrected for chance collisions. Estimates
4.5 deviations below the threshold are dropped; all others are confirmed on the full sets.

No bucket's pairs are listed. First each bucket's members are compared with its least document: a
star. Components of the confirmed links leave few buckets with members of two components; there, the
members outside the least document's component are held against all of other components, block by
block: first on estimates, for which only signatures are sent, then the members of any pair that passes
on full sets, and only links come out. Pairs within one component can't change it, so the components
are those of all links.

Class of a document: component_id, the smallest doc_id it reaches, and whether it is kept.

Nulls: null, empty and blank texts have no shingles and are linked with nothing, not even each other.
A null doc_id is linked with nothing and has component_id null. Rows that repeat a doc_id are one
document with the links of all its texts, and are reported each. Texts of fewer than five words are one shingle. An empty table gives an empty result.
Further columns are ignored by classes() and kept by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import discard, id_text, table, texts, written
from lexgrove.llm.components import components

WORDS = 5
MINIMA, ROWS, BITS = 192, 4, 4
BANDS = MINIMA // ROWS
THRESHOLD = 75
#: The threshold less 4.5 standard deviations of the estimate there.
LEAST_ESTIMATE = 0.60
#: Members of a block whose full sets are compared; such blocks whose signatures are compared at once, on either side; parts that a bucket's rows are joined in.
BLOCK, BLOCKS_AT_ONCE, SALTS = 256, 16, 8
#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 300_000

_random = np.random.default_rng(20240229)
MULTIPLIERS = _random.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_MULTIPLIERS = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_SALTS = _random.integers(1, 1 << 63, BANDS, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's 5-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        x = x * STEP + h[i : len(words) - n + 1 + i]
    return np.unique(mixed(x))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = None
    for i in range(0, len(hashes), 1024):
        m = np.multiply.outer(MULTIPLIERS, hashes[i : i + 1024]).min(1)
        out = m if out is None else np.minimum(out, m)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Bit planes of the lowest BITS bits: (n, BITS, MINIMA / 64) words."""
    low = mixed(mins)
    planes = [np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=-1) for b in range(BITS)]
    return np.ascontiguousarray(np.stack(planes, -2)).view(np.uint64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of signatures that broadcast together, from the counts of equal low bits; chance equality is taken out."""
    differ = np.bitwise_or.reduce(a ^ b, axis=-2)
    equal = 1 - np.bitwise_count(differ).sum(-1) / MINIMA
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        sizes, keys, mins = [], [], np.full((len(ids), MINIMA), 0, np.uint64)
        for i, t in enumerate(texts(batch)):
            s = shingles(t)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            if len(s):
                mins[i] = minima(s)
        bands = mixed((mins.reshape(-1, BANDS, ROWS) * BAND_MULTIPLIERS).sum(-1) + BAND_SALTS).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
        signatures = pa.array([s.tobytes() for s in packed(mins)], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), signatures, lists], names=["doc_id", "n", "set_key", "sig", "bands"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts(batch)], pa.binary())], names=["id", "shingles"])


def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs u, v with signatures a, b -> the pairs whose estimate reaches LEAST_ESTIMATE."""
    for batch in batches:
        if len(batch):
            shape = (len(batch), BITS, MINIMA // 64)
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(shape) for i in (2, 3))
            batch = batch.filter(pa.array(estimates(a, b) >= LEAST_ESTIMATE))
        yield batch.select(["u", "v"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """If two full sets reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their full sets -> the links."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            keep.append(similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])


def same_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows -> (the first `keys` columns, the rows of one value of them)."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield at, rows


MET = pa.schema([("lead", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("side", pa.int32()), ("rid", pa.int64()), ("comp", pa.int64())])


def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lead, X, Y, side, own block, rid, comp, sig: the members of blocks X and Y -> those with an estimate that passes, by pair of blocks."""
    shape = (-1, BITS, MINIMA // 64)
    for (lead, *_), rows in same_group(batches, 3):
        sides = [[r for r in rows if r[3] == k] for k in (0, 1)]
        if not sides[0] or not sides[1]:
            continue
        sigs = [np.frombuffer(b"".join(r[7] for r in own), np.uint64).reshape(shape) for own in sides]
        comps = np.array([r[6] for r in sides[0]])
        out: set[tuple] = set()
        for r, sig in zip(sides[1], sigs[1]):
            for k in np.flatnonzero((estimates(sig, sigs[0]) >= LEAST_ESTIMATE) & (comps != r[6])).tolist():
                other = sides[0][k]
                out.add((lead, r[4], other[4], 0, other[5], other[6]))
                out.add((lead, r[4], other[4], 1, r[5], r[6]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sorted(out)), MET)], schema=MET)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lead, x, y, side, rid, comp, sig, full set: members of two blocks -> links between components.

    One link for each member and component of the block is enough, and no other comes out.
    """
    shape = (-1, BITS, MINIMA // 64)
    for _, rows in same_group(batches, 3):
        block, others = ([r for r in rows if r[3] == k] for k in (0, 1))
        if not block or not others:
            continue
        sigs, comps = np.frombuffer(b"".join(r[6] for r in block), np.uint64).reshape(shape), np.array([r[5] for r in block])
        us, vs = [], []
        for *_, i, comp, sig, own in others:
            mine, met = np.frombuffer(own, np.uint64), set()
            for k in np.flatnonzero((estimates(np.frombuffer(sig, np.uint64).reshape(shape[1:]), sigs) >= LEAST_ESTIMATE) & (comps != comp)).tolist():
                if block[k][5] not in met and similar(mine, np.frombuffer(block[k][7], np.uint64)):
                    met.add(block[k][5])
                    us.append(max(i, block[k][4]))
                    vs.append(min(i, block[k][4]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, shingles: the sets of the documents named by ids.doc_id. The join is of one kind at every size."""
    return written(docs.join(ids.distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary"), "sets")


def links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: those of the pairs whose full sets are similar enough."""
    pairs = written(pairs, "pairs")
    full = full_sets(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")), docs)
    met = pairs.join(full.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(full.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    out = written(met.select("u", "v", "a", "b").mapInArrow(confirmed, "u long, v long"), "links")
    discard(pairs, full)
    return out


def links_across(members: DataFrame, roots: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: links between components of documents that share a bucket. members: lead, rid.

    Buckets with one least document are one group: its members stand there once, however many buckets they
    share. Those outside the least document's component (the few) are held against all, block by block.
    """
    placed = members.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")
    by = placed.groupBy("lead", "comp").agg(F.count("*").alias("n"), F.max(F.col("rid") == F.col("lead")).alias("leads"))
    groups = by.groupBy("lead").agg(F.max(F.when(F.col("leads"), F.col("comp"))).alias("main"), F.sum("n").alias("n"), F.sum(F.when(F.col("leads"), 0).otherwise(F.col("n"))).alias("k")).where("k > 0")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    rest = salted.join(groups.hint("merge"), ["lead", "salt"]).withColumn("few", F.col("comp") != F.col("main"))
    rest = written(rest.select("lead", "rid", "comp", "few", "n", "k"), "rest")
    # Of an item: its own block on either side, and all larger blocks of the other side.
    own = lambda n: F.pmod(F.xxhash64("rid", "lead"), F.ceil(F.col(n) / BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col(n) / BLOCK) - 1) / BLOCKS_AT_ONCE)))
    large = lambda c: F.floor(F.col(c) / BLOCKS_AT_ONCE)
    items = rest.join(sigs, "rid")
    all_ = items.withColumn("own", own("n")).select("lead", each("k").alias("x"), large("own").alias("y"), F.lit(0).alias("side"), "own", "rid", "comp", "sig")
    few = items.where("few").withColumn("own", own("k")).select("lead", large("own").alias("x"), each("n").alias("y"), F.lit(1).alias("side"), "own", "rid", "comp", "sig")
    dealt = all_.union(few).repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    met = written(dealt.mapInArrow(touching, "lead long, x long, y long, side int, rid long, comp long"), "met")
    full = full_sets(met.select(F.col("rid").alias("doc_id")), docs)
    rows = met.join(sigs, "rid").join(full.withColumnRenamed("id", "rid"), "rid").select("lead", "x", "y", "side", "rid", "comp", "sig", "shingles")
    rows = rows.repartition("lead", "x", "y").sortWithinPartitions("lead", "x", "y")
    out = written(rows.mapInArrow(across, "u long, v long").distinct(), "across")
    discard(rest, met, full)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    docs = id_text(docs)
    sketch = written(docs.mapInArrow(sketched, "doc_id long, n long, set_key binary, sig binary, bands array<long>"), "sketch")
    own = sketch.where("n > 0 and doc_id is not null")
    reps = written(own.groupBy("set_key").agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "reps")
    sigs = reps.select("rid", "sig")
    dealt = reps.select("rid", F.explode("bands").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.min("rid").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = written(dealt.join(buckets.hint("merge"), "bucket"), "members")
    stars = members.where("rid <> lead").select(F.col("rid").alias("u"), F.col("lead").alias("v")).distinct()
    met = stars.join(sigs.select(F.col("rid").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("rid").alias("v"), F.col("sig").alias("b")), "v")
    first = links(met.select("u", "v", "a", "b").mapInArrow(promising, "u long, v long"), docs)
    second = links_across(members.select("lead", "rid").distinct(), components(first), sigs, docs)
    discard(members)
    roots = components(first.union(second)).select(F.col("node").alias("rid"), "root")
    discard(first, second)
    least = reps.select("set_key", "rid").join(roots, "rid", "left").select("set_key", F.coalesce("root", "rid").alias("root"))
    out = sketch.select("doc_id", "n", "set_key").join(least.hint("merge"), "set_key", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(linked, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class; the same columns.

    Rows that repeat a kept doc_id all stay.
    """
    gone = classes(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM met JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT u, min(v) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.u = d.doc_id
"""
