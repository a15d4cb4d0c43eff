"""Operators against brute force on small tables, and the cases their docstrings define."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import decontamination, exact_dedup, mixing, near_dedup, pii, queries, shards, substring_dedup, tokens, toxicity
from lexgrove.llm.suffixes import suffix_array
from tests.oracle import rows_of

SCHEMA = "doc_id long, text string, source string, keep_id string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base = [" ".join(word() for _ in range(r.randint(30, 200))) for _ in range(25)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(25):
        w = base[i].split(" ")
        w[r.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w), None))
    out += [(200, base[0], "s0"), (201, base[0].upper(), "s0"), (202, base[0], "s0"), (202, base[0], "s0")]
    out += [(300, None, "s1"), (301, "", "s1"), (302, " \n", "s1"), (303, "two words", None), (None, base[1], "s1"), (304, "é😀" * 4000, "s2")]
    return out


@pytest.mark.parametrize("hot", [10_000, 1])
def test_exact_owners(spark, rows, hot):
    got = exact_dedup.exact_groups(corpus(spark, rows), budget=4096, hot=hot).collect()
    low = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t, _ in rows]
    expect = []
    for i, t in low:
        ids = [j for j, u in low if u == t]
        keep = max((j for j in ids if j is not None), default=None)
        expect.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expect))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_against_their_sql(spark, name):
    found, expected = rows_of(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")
    assert found == expected and found


def test_owners_stay(spark, rows):
    docs = corpus(spark, rows)
    kept = sorted(repr(r.doc_id) for r in exact_dedup.exact_groups(docs).where("kept").collect())
    out = exact_dedup.deduplicated(docs)
    assert out.schema == docs.schema and sorted(repr(r.doc_id) for r in out.collect()) == kept
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0


def test_radix_trie_holds_prefixes_and_spills():
    trie = exact_dedup.RadixTrie()
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 50, b"b" * 49 + b"c"]
    for n, k in enumerate(keys * 2):
        trie.insert(k, n)
    assert sorted(trie.terminals()) == sorted((k, n + len(keys), 2) for n, k in enumerate(keys))
    spilled = list(trie.spill(300))
    assert spilled and sorted([*spilled, *trie.terminals()]) == sorted((k, n + len(keys), 2) for n, k in enumerate(keys))


def test_near_duplicates(spark, rows):
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    reach = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if None not in (a, b) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and reach[a] != (m := min(reach[a], reach[b])):
                    reach[a], changed = m, True
    got = near_dedup.classes(corpus(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len(sets[i]), reach[i], i == reach[i])) for i, _, _ in rows)


def test_suffix_array_is_sorted():
    r = random.Random(3)
    for _ in range(800):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s) + 1), key=lambda i: s[i:])


def repeats(bodies):
    """By brute force: (bytes, removed, spans, hash of the rest, words of passages of 51 words that another document has) of each."""
    count, owners = {}, {}
    for k, b in enumerate(bodies):
        for p in range(len(b) - 399):
            count[b[p : p + 400]] = count.get(b[p : p + 400], 0) + 1
        w = b.lower().split()
        for p in range(len(w) - 50):
            owners.setdefault(tuple(w[p : p + 51]), set()).add(k)
    for b in bodies:
        gone = {q for p in range(len(b) - 399) if count[b[p : p + 400]] > 1 for q in range(p, p + 400)}
        left = bytes(c for q, c in enumerate(b) if q not in gone)
        w = b.lower().split()
        shared = {q for p in range(len(w) - 50) if len(owners[tuple(w[p : p + 51])]) > 1 for q in range(p, p + 51)}
        yield len(b), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(left).hexdigest(), len(shared)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_strings(spark, rows, hot):
    r = random.Random(2)
    passage = " ".join("".join(r.choice("abcd") for _ in range(3)) for _ in range(53))
    more = [(400 + i, f"{rows[i][1][: 60 + i]} {passage.upper() if i == 3 else passage} {rows[24 - i][1][: 70 - i]}", "s") for i in range(8)]
    more += [(410, "la " * 700, "s"), (411, f"{rows[12][1]} {rows[13][1]}", "s"), (412, rows[12][1][:420] + "?" + rows[12][1][421:], "s")]
    # Rows that repeat a document which has a passage twice, in different surroundings.
    more = [(420, f"a {passage[:-9]} b c {passage[:-9].title()} d", "s")] * 2 + more
    rows = rows + more
    bodies = [(t or "").encode() for _, t, _ in rows]
    expect = [(i, *x) for (i, _, _), x in zip(rows, repeats(bodies))]
    assert min(x[5] for x in expect[-11:-3]) >= 51 and expect[-3][5] == 0
    got = substring_dedup.removals(corpus(spark, rows), hot=hot).drop("gone", "text_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect))


def test_repeated_bytes_are_cut_out_of_rows(spark, rows):
    docs = corpus(spark, [*rows, (500, None, "s")])
    out = substring_dedup.deduplicated(docs)
    assert out.schema == docs.schema and out.count() == len(rows) + 1
    bodies = {i: x for (i, _, _), x in zip(rows, repeats([(t or "").encode() for _, t, _ in rows]))}
    for r in out.collect():
        if r.doc_id not in (None, 500, 300, 304):
            assert hashlib.sha256(r.text.encode()).hexdigest() == bodies[r.doc_id][3]
    assert {r.text for r in out.where("doc_id in (300, 500)").collect()} == {None}


def test_word_hashes_hold_wherever_a_word_stands():
    r = random.Random(14)
    words = [bytes(r.choice(b"abcXYZ\xc3") for _ in range(n)) for n in (1, 2, 3, 5, 4095, 4096, 4097, 9000, 70_000)]
    own = {w: int(substring_dedup.word_hashes(np.frombuffer(w, np.uint8))[1][0]) for w in words}
    assert len(set(own.values())) == len(words) and own[words[2]] == substring_dedup.word_hashes(np.frombuffer(words[2].lower(), np.uint8))[1][0]
    order = [r.choice(words) for _ in range(200)]
    at, got = substring_dedup.word_hashes(np.frombuffer(b" \n" + b"\t ".join(order) + b" ", np.uint8))
    assert got.tolist() == [own[w] for w in order] and at[0] == 2
    joined = np.frombuffer(b"".join(order), np.uint8)
    breaks = np.cumsum([0, *map(len, order[:-1])])
    assert substring_dedup.word_hashes(joined, breaks)[1].tolist() == got.tolist()


def test_repeats_in_long_texts(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh ") for _ in range((2 << 20) + 900))
    # A string that begins where one segment ends and the next begins, one within, and a text that is long for its one word.
    docs = corpus(spark, [(1, long, "s"), (2, "x" * 300 + long[(2 << 20) - 250 : (2 << 20) + 200] + "y" * 300, "s"), (3, long[5000:5500], "s"), (4, "z" * 399, "s")])
    got = {x.doc_id: x for x in substring_dedup.removals(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (950, 2) and (got[2].n_removed, got[2].n_spans) == (450, 1)
    assert (got[3].n_removed, got[4].n_removed) == (500, 0)


def test_masks_fit_between_any_three_replaced_words():
    from itertools import combinations

    for gone in combinations(range(decontamination.WINDOW), decontamination.REPLACED):
        assert any(all(m[k] == "0" or s + k not in gone for k in range(len(m))) for m in decontamination.MASKS for s in range(decontamination.WINDOW - len(m) + 1))


def test_decontamination_tolerates_three_replaced_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    w = item.split()[:13]
    three = [*w[:2], "x", *w[3:6], "y", *w[7:11], "z", w[12]]
    four = [*three[:4], "q", *three[5:]]
    docs = corpus(spark, [(1, "so " + " ".join(three) + " end", "s"), (2, " ".join(four), "s"), (3, None, "s"), (4, "", "s"), (None, item, "s")])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too few words")], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.contaminated) for r in decontamination.op2_digest(docs, bench).collect()}
    assert got == {1: ([7], True), 2: (None, False), 3: (None, False), 4: (None, False), None: ([7], True)}
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench).collect()) == [2, 3, 4]
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == 5


def test_decontamination_against_all_alignments(spark):
    """Short and long items, several lots, repeated words: every alignment of every item with every text."""
    r = random.Random(6)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") * 2
    items = [[word() for _ in range(n)] for n in (*range(1, 16), 30, 60) for _ in range(2)] + [["ho"] * 20, ["ho", "hi"] * 9, []]
    texts = []
    for k in range(60):
        t = list(r.choice(items))
        for _ in range(r.randint(0, 4)):
            if t:
                t[r.randrange(len(t))] = word()
        texts.append([word() for _ in range(r.randint(0, 9))] + t[r.randint(0, 2) :] + [word() for _ in range(r.randint(0, 9))])
    texts += [["ho"] * 50, ["ho", "hi"] * 30, []]

    def hit(text, item):
        size = min(13, len(item))
        allowed = {13: 3, 12: 2, 11: 2, 10: 2, 9: 2, 8: 1}.get(size, 0)
        return size > 0 and any(sum(x != y for x, y in zip(text[a : a + size], item[b : b + size])) <= allowed for a in range(len(text) - size + 1) for b in range(len(item) - size + 1))

    expect = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if hit(t, item)}
    docs = corpus(spark, [(i, " ".join(t).title(), "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(j, ", ".join(t), "clash") for j, t in enumerate(items)], "item_id long, text string, doc_id string")
    for most in (1 << 20, 50):
        got = decontamination.matches(docs, bench, most)
        assert {(x.doc_id, x.item_id) for x in got.collect()} == expect
        kept = decontamination.decontaminated(docs, bench, most)
        assert sorted(x.doc_id for x in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in expect})


def test_decontamination_of_a_text_of_one_word():
    h = decontamination.word_hashes(b"la " * 20_000)
    began = time.time()
    assert len(decontamination.Lot.of([h[:400]]).overlaps(h)) == 20_000 - 13 + 400 - 13 + 1
    assert time.time() - began < 10


def test_token_counts_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokens.model_path()
    lib, machine = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Transducer(path)
    r = random.Random(5)
    cases = ["", " ", "<s> x </s>", "a\n\nb", "x" * 300, " " * 70 + "a", "é😀\x00▁b"]
    cases += ["".join(r.choice("aabcdeinrst  ▁\nÉ😀THE.,1") for _ in range(r.randint(0, 80))) for _ in range(400)]
    cases += ["".join(r.choice("abcdehilnoprst") for _ in range(3000)), "the" * 900]
    for chunk, mark, scanned in ((5, 2, 3), (70, 64, 64), (1 << 14, 64, 64)):
        old = tokens.CHUNK, tokens.MARK, tokens.SCANNED
        tokens.CHUNK, tokens.MARK, tokens.SCANNED = chunk, mark, scanned
        assert [machine.count(t) for t in cases] == [len(x) for x in lib.encode(cases)]
        tokens.CHUNK, tokens.MARK, tokens.SCANNED = old


def test_chunk_maps_hold_for_every_entry():
    machine = tokens.Transducer(tokens.model_path())
    before, chunk, after = "unbelie", "vabletheoryofeverything" * 30, "and more"
    entry, n = machine.run(machine.start, before)
    maps = [tokens.ChunkMap(machine, x) for x in (chunk, after.replace(" ", tokens.SPACE))]
    whole = machine.run(machine.start, before + chunk + after.replace(" ", tokens.SPACE))
    for m in (tokens.Composed(*maps), machine.scan(maps)[-1]):
        got = m(entry)
        assert (n + got[0], got[1]) == (whole[1], whole[0])


def test_tokens_of_a_long_text_without_spaces():
    """Time and memory grow with the text, not with its square."""
    sentencepiece = pytest.importorskip("sentencepiece")
    machine = tokens.Transducer(tokens.model_path())
    r = random.Random(8)
    part = "".join(r.choice("abcdehilnoprst") for _ in range(50_000))
    assert machine.count(part) == len(sentencepiece.SentencePieceProcessor(model_file=tokens.model_path()).encode(part))
    long, took = part * 160, []
    for n in (2_000_000, 8_000_000):
        began = time.time()
        machine.count(long[:n])
        took.append(time.time() - began)
    assert took[1] < 10 * took[0]
    tracemalloc.start()
    machine.count(long)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_token_counts_of_nulls_and_repeats(spark):
    docs = corpus(spark, [(None, "two words", "s"), (1, None, "s"), (2, "", "s"), (3, "two words", "s"), (3, "two words", "s")]).withColumn("n_tokens", F.lit(-1))
    got = sorted(repr(tuple(x)) for x in tokens.token_counts(docs).collect())
    n = tokens.Transducer(tokens.model_path()).count("two words")
    assert got == sorted(map(repr, [(None, 9, n, False), (1, 0, 0, False), (2, 0, 0, False), (3, 9, n, False), (3, 9, n, False)]))


def test_personal_data(spark):
    texts = ["mail a@b.c_d@e.f 1.2.3.4 256.1.1.1", "card 4111 1111 1111 1111 +1 (555) 123-4567", "😀 x@y.zz", "", None, "9" * 5000]
    got = {r.doc_id: r for r in pii.digest(corpus(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert (got[0].n_email, got[0].n_ip, got[1].n_card, got[1].n_phone, got[2].spans) == (2, 1, 1, 1, "email:2:8")
    assert all(got[i].spans == "" for i in (3, 4, 5))
    out = {r.doc_id: r.text for r in pii.redacted(corpus(spark, [(1, texts[1], "s"), (4, None, "s")])).collect()}
    assert out == {1: "card [CARD] [PHONE]", 4: None}


def test_shards_are_even_and_slots_gapless(spark, rows):
    got = shards.assign(corpus(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    largest = max(len((t or "").encode()) + 1 for _, t, _ in rows)
    total = sum(r["size"] for r in got)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 16 + 2 * largest
    expect = sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, _ in rows)
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in got) == expect
    out = shards.resharded(corpus(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.shard, r.slot)) for r in out) == sorted(repr((r.doc_id, r.shard, r.slot)) for r in got)


def test_flow_moves_the_fewest_bytes():
    def least(supply, capacity):
        if not supply:
            return 0
        best = None
        for parts in itertools.product(*[range(min(supply[0], c) + 1) for c in capacity]):
            if sum(parts) == supply[0]:
                rest = least(supply[1:], [c - p for c, p in zip(capacity, parts)])
                if rest is not None:
                    cost = sum(p for j, p in enumerate(parts) if j != len(SUPPLY) - len(supply)) + rest
                    best = cost if best is None else min(best, cost)
        return best

    r = random.Random(9)
    for _ in range(60):
        SUPPLY = [r.randint(0, 4) for _ in range(r.randint(1, 3))]  # noqa: N806
        capacity = shards.even(sum(SUPPLY), r.randint(1, 4))
        flow = shards.min_cost_flow(SUPPLY, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(SUPPLY))] == SUPPLY
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        assert sum(v for (i, j), v in flow.items() if i != j) == least(SUPPLY, capacity)


def test_copies_of_a_row_lie_apart(spark):
    docs = corpus(spark, [(i // 4, f"text {i // 4}", "s") for i in range(4000)])
    slots = {}
    for r in shards.resharded(docs, shards=2).collect():
        slots.setdefault((r.doc_id, r.shard), []).append(r.slot)
    near = sum(b - a < 100 for s in slots.values() for a, b in zip(sorted(s), sorted(s)[1:]))
    assert near == 0


@pytest.mark.parametrize("old, new", [(4, 2), (2, 4)])
def test_rewritten_shards_hold_each_row_once(spark, tmp_path, old, new):
    path = str(tmp_path / "shards")
    docs = corpus(spark, [(i, f"text {i}" * (i % 7), "s") for i in range(400)])
    docs.withColumn("shard", F.col("doc_id") % old).withColumn("slot", F.lit(0)).write.partitionBy("shard").parquet(path)
    before = spark.read.parquet(path)
    shards.rewrite(before, path, old_shard=F.col("shard"), shards=new)
    after = spark.read.parquet(path).collect()
    assert sorted(r.doc_id for r in after) == list(range(400)) and {r.shard for r in after} == set(range(new))
    for k in range(new):
        own = [r.slot for r in after if r.shard == k]
        assert sorted(own) == list(range(len(own)))
    shards.rewrite(spark.read.parquet(path), path, old_shard=F.col("shard"), shards=new)
    assert spark.read.parquet(path).count() == 400


def test_mixing_draws_alike_and_leaves_out_weightless_sources(spark, rows):
    docs = corpus(spark, rows)
    one, two = (sorted(map(str, mixing.mixed(docs).collect())) for _ in range(2))
    assert one == two
    only = mixing.mixed(docs, weights={"s0": 1.0, None: 0.0}, size=5.0).collect()
    assert {r.source for r in only} == {"s0"} and len(only) > len(rows)


def test_toxicity_grades(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    fit = [(" ".join([word() for _ in range(40)] + ["vile"] * (3 * y * (1 + k % 2))).encode(), y) for k in range(200) for y in (0, 1)]
    model = toxicity.fit_ordinal(fit)
    mild, severe, none = (sum(model.probabilities(t)) for t in (b"a vile " + b"word " * 30, b"vile vile vile word word", b"word word"))
    assert none < 0.3 < mild < severe and model.probabilities(b"") == (0.0, 0.0)
    assert toxicity.fit_ordinal([(b"x", 0)]).probabilities(b"x") == (0.0, 0.0)


def test_empty_tables(spark, rows):
    docs = corpus(spark, rows).limit(0)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    for out in (exact_dedup.exact_groups(docs), near_dedup.classes(docs), substring_dedup.removals(docs), decontamination.op2_digest(docs, bench), mixing.mixed(docs), shards.assign(docs), pii.digest(docs), tokens.token_counts(docs)):
        assert out.count() == 0
