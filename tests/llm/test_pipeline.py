"""Pipeline stages against brute force, each on its own input, and the cases every stage must bear."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from lexgrove.llm.decontamination import REPLACED, WINDOW

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
#: Names that operators use within, and some of other tables.
CLASHES = ["keep_id", "rid", "bucket", "_row", "_id", "_gone", "_n", "_crc", "_group", "_u", "cdf", "rate", "size", "block", "old", "at", "item_id", "severity"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(r.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            w[3::4] = ["vile"] * len(w[3::4])
        docs.append((i, " ".join(w), f"s{min(2, i % 5)}"))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + k, docs[k][1] + " more", None) for k in range(1, 40, 7)]
    docs += [(400, f"see {ITEM} there", "s1"), (401, "short", "s1"), (402, docs[1][1], "s2"), (402, docs[1][1], "s2")]
    docs += [(500, None, "s1"), (500, "", "s1"), (501, "", None), (None, docs[2][1], "s0"), (None, None, None), (502, "é😀 " * 9000, "s0")]
    home = str(tmp_path_factory.mktemp("tables"))
    extra = ", ".join(f"'{c}' AS {c}" for c in CLASHES)
    spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars", f"struct({extra}) AS x").select("doc_id", "text", "lang", "source", "n_chars", "x.*").write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def by_hand_near(docs):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    ids = [(i, shingles(t)) for i, t, _ in docs if i is not None]
    least = {i: i for i, _ in ids}
    moved = True
    while moved:
        moved = False
        for a, x in ids:
            for b, y in ids:
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and least[b] < least[a]:
                    least[a], moved = least[b], True
    return [d for d in docs if d[0] is None or least[d[0]] == d[0]]


def by_hand_leaks(docs):
    item = ITEM.split()

    def leaks(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return any(sum(a != b for a, b in zip(w[i : i + WINDOW], item[j : j + WINDOW])) <= REPLACED for i in range(len(w) - WINDOW + 1) for j in range(len(item) - WINDOW + 1))

    return [d for d in docs if not leaks(d[1])]


def by_hand_mix(docs):
    n = Counter(s for _, _, s in docs)
    weight = {s: math.sqrt(k) for s, k in n.items()}
    out = []
    for i, t, s in docs:
        rate = weight[s] / sum(weight.values()) * len(docs) / n[s]
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:12], 16) / 2**48
        copies, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            copies += 1
            p *= rate / copies
            c += p
        out += [(i, t, s)] * copies
    return out


def test_each_stage_does_what_brute_force_does(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), hand in zip(pipeline.STAGES, [None, by_hand_near, by_hand_leaks, by_hand_mix, list]):
        before = rows(docs)
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}.out"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if hand is None:
            expect = [d for d in before if "vile" not in (d[1] or "")]  # copies of toxic texts go as well
        else:
            expect = hand(before)
        assert Counter(rows(docs)) == Counter(expect), name
        assert docs.columns == (columns if name != "sharding" else [*columns, "shard", "slot", "moved"])
    slots = {}
    for r in docs.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(rows(pipeline.run(spark, folder))) == Counter(rows(docs))


def test_a_null_and_an_empty_text_of_one_document_get_two_slots(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (1, ""), (2, "x")], "doc_id long, text string")
    out = pipeline.deal_shards(spark, docs, "").collect()
    assert len(out) == 4 and len({(r.shard, r.slot) for r in out}) == 4
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, None), (1, ""), (1, ""), (2, "x")])


def test_stages_take_empty_tables(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
