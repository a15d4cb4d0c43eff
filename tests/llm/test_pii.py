"""Op 7: candidates of its generators, base spans against a plain reading of the contract, long texts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from lexgrove.llm import pii

FULL = ":".join(["20ab"] * 8)
CASES = [
    ("email", "to jane (at) example.com now", ["jane (at) example.com"]),
    ("email", "JANE(AT)EXAMPLE(DOT)COM", ["JANE(AT)EXAMPLE(DOT)COM"]),
    ("email", "jane [at] mail.example dot com", ["jane [at] mail.example dot com"]),
    ("email", "jane @ example dot co.uk", ["jane @ example dot co.uk"]),
    ("email", "jane at example dot com", ["jane at example dot com"]),
    ("email", "jane@example.com, at home", []),
    ("ip", "host 2001:db8::1 is up", ["2001:db8::1"]),
    ("ip", "host ::1, fe80:: and " + FULL, ["::1", "fe80::", FULL]),
    ("ip", "std::vector at 10:20:30", []),
]


def test_spelled_and_compressed_addresses_are_candidates(spark):
    texts = spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(CASES)], "n int, text string")
    texts = texts.withColumns({k: pii.pieces(F.col("text"), pii.MORE[k], pii.MORE_NEEDS[k]) for k in ("email", "ip")})
    found = [F.transform(pii.spans(F.col(k)), lambda s: s["match"]).alias(k) for k in ("email", "ip")]
    got = {r.n: r for r in texts.select("n", *found).collect()}
    assert [list(got[n][k]) for n, (k, _, _) in enumerate(CASES)] == [c for _, _, c in CASES]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    """As the contract reads: leftmost matches that don't overlap, kind by kind, then the checks."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    out = []
    for rank, (kind, pattern, ok) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m[0])]
    return [x for _, _, x in sorted(out)]


def made(r):
    parts = ["a@b.co", "x.y%z@q-r.s.t", "@", "1.2.3.4", "10.0.0.256", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49 30 1234", " ", " ", "\n", "é", "😀", ".", "-", "12", "007", "abc", "00:11"]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 30)))


def test_base_spans_against_a_plain_reading(spark):
    r = random.Random(12)
    rows = [(i, made(r)) for i in range(1500)] + [(7, made(r)), (7, "a@b.co"), (7, "a@b.co"), (None, "a@b.co 1.2.3.4"), (8, None)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, base int, `all` string")
    got = pii.digest(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    expect = []
    for i, t in rows:
        own = base_spans(t or "")
        expect.append((i, *[sum(x.startswith(k + ":") for x in own) for k in pii.KINDS], hashlib.sha256(",".join(own).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expect))
    assert pii.digest(docs.limit(0)).count() == 0


def test_many_matches_take_linear_time(spark):
    n = 100_000
    text = " ".join(f"é{k % 7}@b.co 1.2.3.{k % 256}" for k in range(n // 2)) + " end jane (at) example.com"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest(docs).first()
    assert time.time() - began < 120
    own = base_spans(text)
    assert (got.n_email, got.n_ip) == (n // 2, n // 2) and got.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()


def test_redacted_texts(spark):
    r = random.Random(13)
    texts = [made(r) * r.choice([1, 1, 40]) for _ in range(60)] + ["x" * 4095 + "é@b.co" + "y" * 9000 + " a@b.co", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x["all"] for x in pii.found(docs).collect()}
    got = {x.doc_id: x.text for x in pii.redacted(docs).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s in found[i]:
            if s.start >= at:
                out += t[at : s.start] + f"[{pii.KINDS[s.rank].upper()}]"
            at = max(at, s.end)
        assert got[i] == (None if t is None else out + t[at:])
