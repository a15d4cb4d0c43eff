"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z. Two rounds of tries:

1. Each scan task inserts its texts into one compressed radix trie, whose terminals hold the
   largest identifier and the count seen. A third of all rows being copies of one text thus
   leaves each task as one row. When the trie holds more than ``budget`` bytes, its largest
   subtree spills: its terminals go to the shuffle as partial owners, and the subtree starts anew.
2. Partial owners are dealt by (length, content hash) and sorted by it, so that a task streams
   one bucket after another through a trie of full byte strings. Different texts with one length
   and hash end in different terminals.

Owners are joined back to the documents by SHA-256. Those of texts with over HOT copies, of which there
are at most one for each HOT rows, are broadcast once their bytes are counted, so a hot text's rows
stay where they are; the other rows meet their owners in a shuffle, in which no text has more.

Nulls: a null text is an empty text. A null doc_id never owns a text unless all its copies have
null; then keep_id is null and each copy is kept. Repeated rows (one doc_id, one text) count in
group_size each and are all kept or all dropped. An empty table gives an empty result. Further
columns are ignored by owners() and kept by deduplicated().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import id_text, table, texts, written

BUDGET = 32 << 20
#: Copies from which on a text is hot, and the bytes of hot texts' owners up to which they are broadcast; beyond, all texts are joined alike.
HOT, BROADCAST = 10_000, 32 << 20
OWNER_BYTES = 96


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by bisection on slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("label", "children", "terminal", "owner", "count")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.terminal, self.owner, self.count = label, {}, False, None, 0


class RadixTrie:
    """A compressed trie of byte strings; terminals own a string by the largest identifier."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held: dict[int, int] = {}

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.children.get(key[at])
            if child is None:
                new = Node(key[at:])
                node.children[key[at]] = new
                self.held[key[0]] = self.held.get(key[0], 0) + end - at + 200
                node, at = new, end
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                n = common_prefix(child.label, key[at : at + len(child.label)])
                fork = Node(child.label[:n])
                child.label = child.label[n:]
                fork.children[child.label[0]] = child
                node.children[fork.label[0]] = fork
                self.held[key[0]] += 200
                node, at = fork, at + n
        node.terminal = True
        node.count += count
        if owner is not None and (node.owner is None or owner > node.owner):
            node.owner = owner

    def terminals(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """(string, owner, count) of the whole trie, or of the subtree whose strings begin with a byte."""
        stack = [(b"", self.root if first is None else self.root.children[first])]
        while stack:
            before, node = stack.pop()
            key = before + node.label
            if node.terminal:
                yield key, node.owner, node.count
            stack.extend((key, c) for c in node.children.values())

    def spill(self, budget: int) -> Iterator[tuple[bytes, int | None, int]]:
        """Empties the largest subtrees until at most half the budget is held."""
        if sum(self.held.values()) > budget:
            while sum(self.held.values()) > budget // 2:
                first = max(self.held, key=self.held.get)
                yield from self.terminals(first)
                del self.root.children[first], self.held[first]


PARTIAL = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("key", pa.binary()), ("owner", pa.int64()), ("count", pa.int64())])
OWNERS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
ROW_BYTES = 4 << 20


def packed(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of bytes; weigh is the column of byte strings."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh]) + 64
        if size > ROW_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def partial_owners(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = RadixTrie()
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                    trie.insert(text.lower(), doc_id)
                    yield from trie.spill(budget)
            yield from trie.terminals()

        def keyed():
            for key, owner, count in rows():
                yield len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), key, owner, count

        yield from packed(keyed(), PARTIAL, 2)

    return run


def final_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (length, hash); each bucket has a trie of its own."""

    def rows():
        bucket, trie = None, RadixTrie()
        for batch in batches:
            length, hashed, key, owner, count = (batch.column(i) for i in range(5))
            for at, k, o, c in zip(zip(length.to_pylist(), hashed.to_pylist()), key, owner.to_pylist(), count.to_pylist()):
                if at != bucket:
                    yield from trie.terminals()
                    bucket, trie = at, RadixTrie()
                trie.insert(k.as_py(), o, c)
        yield from trie.terminals()

    def hashed():
        for key, owner, count in rows():
            yield hashlib.sha256(key).digest(), owner, count

    yield from packed(hashed(), OWNERS, 0)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = [hashlib.sha256(t.lower()).digest() for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary())], names=["_id", "_sha"])


def owners(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """sha, keep_id, group_size: one row for each different text."""
    partial = id_text(docs).mapInArrow(partial_owners(budget), "length long, hash long, key binary, owner long, count long")
    dealt = partial.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(final_owners, "sha binary, keep_id long, group_size long")


def with_owners(rows: DataFrame, found: DataFrame, hot: int = HOT) -> DataFrame:
    """rows, which have _sha and _id, with keep_id and group_size. found: owners(), written."""
    few = found.where(F.col("group_size") > hot)
    if few.count() * OWNER_BYTES > BROADCAST:
        few = few.limit(0)
    both = lambda df, name: df.select(F.col("sha").alias(f"_{name}"), F.struct("keep_id", "group_size").alias(f"_by_{name}"))
    met = rows.join(F.broadcast(both(few, "hot")), F.col("_sha") == F.col("_hot"), "left")
    # Rows that are served have a key of their own, which meets nothing and lies anywhere.
    key = F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(F.unhex(F.sha1(F.concat_ws(":", F.col("_id").cast("string"), F.hex("_sha"))))).alias("_key")
    met = met.withColumn("_key", key).join(both(found, "cold").hint("merge"), F.col("_key") == F.col("_cold"), "left")
    by = F.coalesce("_by_hot", "_by_cold")
    return met.withColumns({"keep_id": by["keep_id"], "group_size": by["group_size"]}).drop("_hot", "_by_hot", "_cold", "_by_cold", "_key")


def exact_groups(docs: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each document."""
    found = written(owners(docs, budget), "owners")
    own = id_text(docs).mapInArrow(digests, "_id long, _sha binary")
    met = with_owners(own, found, hot)
    return met.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """docs with the owner of each text only; the same columns."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = written(owners(docs, budget), "owners")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.unhex(F.sha2(low.cast("binary"), 256)).alias("_sha"))
    return with_owners(rows, found).where(F.col("_id").eqNullSafe(F.col("keep_id"))).select("_row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
