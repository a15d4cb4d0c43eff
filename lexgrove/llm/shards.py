"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. Documents are cut into blocks of an old shard
by a hash; only block sizes reach the driver, one number for each block of about BLOCK_ROWS rows. A
minimum-cost flow from old sizes to new capacities, with cost 1 for each byte that changes shard
and 0 for each that stays, says how many bytes of each old shard go where. Each old shard's blocks
are laid end to end and cut at the flow's amounts, so only blocks at a cut are split, at the
document whose middle lies beyond it.

Law: ``bytes``. Shard sizes differ by at most the documents at the cuts. Equal texts are the groups
that may be hot: under this law they can't have a shard in common, as a third of all rows would make
one shard larger than the others; they are spread by their doc_ids.

Slots: documents stand in hash order within their blocks, and the running number in the shard is
multiplied with a number near 0.618 of the shard's rows that has no factor in common with them. So
each slot is taken once, and rows that are alike, as mixing makes them, lie far apart.

Places are found on slim rows (no texts); whole rows are shuffled once, by block, and get their places
in passing.

Nulls: a null text has size 1 and the CRC of no bytes; a null doc_id is a value of its own; a null old
shard is shard 0. Repeated rows each have a slot; which of them has which goes by a hash of all their
columns that aren't maps, so that retried tasks agree. With fewer documents than shards some shards
stay empty. An empty table gives an empty result. Further columns are ignored by assign() and kept by
resharded().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.llm.common import discard, table, written

SHARDS = 16
OLD_SHARDS = 12
#: Rows of a block, about; blocks of an old shard at least.
BLOCK_ROWS, LEAST_BLOCKS = 20_000, 16


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one; sum(capacity) >= sum(supply).

    Successive shortest paths: of all flows that place every byte, one that moves the fewest.
    """
    m, n = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        source = next(i for i in range(m) if left[i])
        far = {("o", source): 0}
        back: dict = {}
        changed = True
        while changed:
            changed = False
            for (side, k), d in list(far.items()):
                edges = [(("n", j), d + (j != k)) for j in range(n)] if side == "o" else [(("o", i), d - (i != k)) for i in range(m) if flow.get((i, k))]
                for to, cost in edges:
                    if cost < far.get(to, 1 << 60):
                        far[to], back[to] = cost, (side, k)
                        changed = True
        target = min((("n", j) for j in range(n) if room[j]), key=lambda x: (far[x], x[1]))
        path, at = [], target
        while at != ("o", source):
            path.append((back[at], at))
            at = back[at]
        amount = min([left[source], room[target[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "n")])
        for a, b in path:
            key = (a[1], b[1]) if a[0] == "o" else (b[1], a[1])
            flow[key] = flow.get(key, 0) + (amount if a[0] == "o" else -amount)
        left[source] -= amount
        room[target[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def block_cuts(sizes: dict[tuple[int, int], int], flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, new shard, first byte, last byte + 1), bytes counted within the block."""
    cuts = []
    for old in sorted({o for o, _ in sizes}):
        parts = sorted(((new != old, new, size) for (o, new), size in flow.items() if o == old))
        at, left = 0, parts[0][2] if parts else 0
        for block in sorted(b for o, b in sizes if o == old):
            done, size = 0, sizes[old, block]
            while done < size:
                take = min(size - done, left)
                if take:
                    cuts.append((old, block, parts[at][1], done, done + take))
                done, left = done + take, left - take
                if not left and at + 1 < len(parts):
                    at += 1
                    left = parts[at][2]
    return cuts


def default_old_shard() -> Column:
    """The layout before: 12 shards by the CRC of doc_id."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")


def share(total: int, capacities: list[float]) -> list[int]:
    whole = [int(total * c / sum(capacities)) for c in capacities]
    for j in range(total - sum(whole)):
        whole[j % len(whole)] += 1
    return whole


KEY = ["_id", "_size", "_crc"]


def keyed(docs: DataFrame, old_shard: Column | None, rows: bool) -> DataFrame:
    """_id, _size, _crc, _old and _mark of each row; with rows, _row (all its columns) and _tie."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    old = default_old_shard() if old_shard is None else old_shard
    whole = [F.struct(*docs.columns).alias("_row"), F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t]).alias("_tie")] if rows else []
    out = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(body).alias("_crc"),
        F.coalesce(old.cast("int"), F.lit(0)).alias("_old"),
        *whole,
    )
    return out.withColumn("_mark", F.xxhash64(*KEY))


def placed(keys: DataFrame, blocks: int, cuts: list, ties: list[str]) -> DataFrame:
    """keys with each row's new shard (_shard), its block and its running number there (_at). cuts: blocks and splits, one or two for each block."""
    order = W.partitionBy("_old", "_block").orderBy("_mark", *KEY, *ties)
    each = keys.withColumn("_block", F.pmod("_mark", F.lit(blocks)).cast("int"))
    each = each.withColumns({"_before": F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size"), "_at": F.row_number().over(order) - 1})
    middle = F.col("_before") + F.floor(F.col("_size") / 2)
    plan = keys.sparkSession.createDataFrame(cuts, "_old int, _block int, _shard int, _low long, _high long")
    return each.join(F.broadcast(plan), ["_old", "_block"]).where((middle >= F.col("_low")) & (middle < F.col("_high"))).drop("_low", "_high", "_before", "_mark")


def stride(n: int) -> int:
    """A number near 0.618 n, small enough for the product, that has no factor in common with n."""
    k = max(1, min(round(n * 0.6180339887), 1 << 31))
    while math.gcd(k, n) != 1:
        k -= 1
    return k


def with_places(docs: DataFrame, old_shard: Column | None, capacities: list[float] | None, shards: int, block_rows: int, rows: bool) -> DataFrame:
    """The rows of keyed() with _shard and _slot."""
    spark = docs.sparkSession
    slim = written(keyed(docs, old_shard, False), "shards")
    olds, count = slim.agg(F.max("_old"), F.count("*")).first()
    blocks = max(LEAST_BLOCKS, -(-count // (block_rows * (1 + (olds or 0)))))
    sizes = {(r._old, r._b): r.n for r in slim.groupBy("_old", F.pmod("_mark", F.lit(blocks)).cast("int").alias("_b")).agg(F.sum("_size").alias("n")).collect()}
    total = sum(sizes.values())
    wanted = even(total, shards) if capacities is None else share(total, capacities)
    supply = [0] * (1 + (-1 if olds is None else olds))
    for (o, _), b in sizes.items():
        supply[o] += b
    cuts = block_cuts(sizes, min_cost_flow(supply, wanted))
    found = placed(slim, blocks, cuts, [])
    first: dict[int, int] = {}
    offsets = []
    for r in sorted(found.groupBy("_old", "_block", "_shard").agg(F.count("*").alias("n"), F.min("_at").alias("least")).collect()):
        offsets.append((r._old, r._block, r._shard, first.get(r._shard, 0) - r.least))
        first[r._shard] = first.get(r._shard, 0) + r.n
    steps = [(*x, first[x[2]], stride(first[x[2]])) for x in offsets]
    moved = spark.createDataFrame(steps, "_old int, _block int, _shard int, _add long, _n long, _stride long")
    if rows:
        found = placed(keyed(docs, old_shard, True), blocks, cuts, ["_tie"])
        discard(slim)
    out = found.join(F.broadcast(moved), ["_old", "_block", "_shard"])
    return out.withColumn("_slot", F.pmod((F.col("_at") + F.col("_add")) * F.col("_stride"), F.col("_n")).cast("long"))


def assign(docs: DataFrame, old_shard: Column | None = None, capacities: list[float] | None = None, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot: one row for each document.

    capacities: relative; equal by default. old_shard: a small non-negative integer.
    """
    out = with_places(docs, old_shard, capacities, shards, block_rows, False)
    return out.select(*[F.col(a).alias(b) for a, b in (("_id", "doc_id"), ("_size", "size"), ("_crc", "text_crc32"), ("_old", "old_shard"), ("_shard", "shard"), ("_slot", "slot"))])


def resharded(docs: DataFrame, old_shard: Column | None = None, capacities: list[float] | None = None, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with the columns shard, slot and moved, whatever else it has. Columns of docs with these names are replaced."""
    out = with_places(docs, old_shard, capacities, shards, block_rows, True)
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot", "moved")]
    return out.select(*own, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), (F.col("_shard") != F.col("_old")).alias("moved"))


def rewrite(docs: DataFrame, path: str, old_shard: Column | None = None, **options) -> None:
    """Rewrites the affected files below path/shard=N: of the shards that give or take a document. docs may be read from path.

    All rows of these shards are first written to the shared folder, then take their partitions' places
    (dynamic partition overwrite); at last the folders of shards that have lost all documents, which an
    overwrite leaves as they are, are deleted. The other shards keep their files, and their slots in them.
    """
    spark = docs.sparkSession
    old = F.coalesce((default_old_shard() if old_shard is None else old_shard).cast("int"), F.lit(0))
    out = written(resharded(docs.withColumn("_was", old), old_shard=old, **options), "resharded")
    pairs = out.groupBy("_was", "shard").agg(F.count("*")).collect()
    touched = {s for was, now, _ in pairs if was != now for s in (was, now)}
    rows = out.drop("_was", "moved").where(F.col("shard").isin(sorted(touched)))
    rows.repartition("shard", F.pmod("slot", F.lit(64))).sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for gone in sorted(touched - {now for _, now, _ in pairs}):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={gone}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    discard(out)


def op10_digest(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_digest(table(spark, sf_dir, "documents"))
