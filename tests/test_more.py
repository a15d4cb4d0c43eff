"""Operators that SQL can't express, against brute force and fixed cases."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexgrove.functions.embedding import hashed, hashing_embed
from lexgrove.functions.privacy import PATTERNS, redact
from lexgrove.queries import QUERIES
from lexgrove.sources.html import decoded, html_blocks, html_lines, page_blocks
from lexgrove.sources.raw import raw_files, replace_documents
from lexgrove.streaming.admission import admitted_stream

SF = "/root/testdata/sf0.01"


def by_hand(events):
    kept, out = {}, {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        mine = kept.setdefault(e["user_id"] % 4, [])
        recent = [t for t in mine if (e["ts"] - t).total_seconds() < 3600]
        out[e["event_id"]] = len(recent) < 3
        if out[e["event_id"]]:
            mine.append(e["ts"])
    return out


def test_admission_of_a_table_and_of_a_stream(spark, tmp_path):
    expect = by_hand(pq.read_table(f"{SF}/events.parquet").to_pylist())
    assert {r.id: r.allowed for r in QUERIES["rate_limit"](spark, SF).collect()} == expect
    assert sum(expect.values()) == 5982
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("client", F.col("user_id") % 4)
    (tmp_path / "in").mkdir()
    events.orderBy("ts", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/a")
    run = admitted_stream(stream, "client", "ts", "event_id", 3600, 3).writeStream.format("memory").queryName("admission").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.id: r.allowed for r in spark.table("admission").collect()} == expect


def test_html_lines_and_struck_blocks(spark):
    page = "<head><title>x</title></head><body>a <b>5</b>7<br>b\n c<p><strike>old <i>text</i></strike></p><div>d<s>gone</s>e<p style='text-decoration: line-through'>z</p>f</div><script>var t='</p>';</script><p><b>g</p>h &amp; i"
    assert page_blocks(page) == [("a 57", False), ("b c", False), ("old text", True), ("de", False), ("z", True), ("f", False), ("g", False), ("h & i", False)]
    assert page_blocks("<p>no</p><div class='a texto-dou'>yes<br/>too</div><p>no</p>", "gazette") == [("yes", False), ("too", False)]
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [r.line for r in html_lines(rows).orderBy("page_id", "line_no").collect()] == ["a 57", "b c", "de", "f", "g", "h & i"]
    assert [r.error for r in html_blocks(rows.where("page_id = 3"), layout="portal").collect()] == ["no container of layout portal"]
    assert decoded("é".encode("cp1252")) == "é" == decoded(b"<meta charset=latin-1>\xe9")[-1]


def test_redaction_is_numbered(spark):
    texts = ["CPF 111.444.777-35 e 111.444.777-36, CNPJ 11.222.333/0001-81, a@b.com, x@y.org, (11) 98765-4321", "", None, "no é data 123"]
    out = [tuple(r) for r in redact(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()]
    assert out[0] == (0, "CPF [CPF_1] e 111.444.777-36, CNPJ [CNPJ_1], [EMAIL_1], [EMAIL_2], [PHONE_1]", 1, 1, 2, 1)
    assert out[1:] == [(1, "", 0, 0, 0, 0), (2, None, 0, 0, 0, 0), (3, texts[3], 0, 0, 0, 0)]


def test_redacted_mails_are_those_of_the_pattern(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r.n_email for r in QUERIES["redact_counts"](spark, SF).collect()}
    assert got == {d["doc_id"]: len(re.findall(PATTERNS["EMAIL"], d["text"] or "")) for d in docs} and sum(got.values())


def test_hashed_vectors(spark):
    v = hashed("Uma lei uma LEI", 16)
    place = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 16
    assert v[place("uma")] == v[place("lei")] == pytest.approx(0.5**0.5) and not hashed("", 4).any()
    out = spark.createDataFrame([("a b",), (None,)], "t string").select(hashing_embed(F.col("t"), 4).alias("v")).collect()
    assert sum(x * x for x in out[0].v) == pytest.approx(1) and out[1].v == [0, 0, 0, 0]


def test_raw_files_and_replaced_documents(spark, tmp_path):
    for name in ("a.html", "b.html", "c.html"):
        (tmp_path / name).write_bytes(name.encode())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = spark.createDataFrame([("a.html", sha("a.html")), ("b.html", sha("x")), ("d.html", None)], "name string, source_sha256 string")
    assert {r.name: r.state for r in raw_files(spark, f"{tmp_path}/*.html", listed).collect()} == {"a.html": "same", "b.html": "changed", "c.html": "unlisted", "d.html": "missing"}
    make = lambda *rows: spark.createDataFrame(rows, "document_id string, id int")
    replace_documents(make(("x", 1), ("x", 2), ("y", 3)), f"{tmp_path}/t")
    replace_documents(make(("x", 9)), f"{tmp_path}/t")
    assert sorted((r.document_id, r.id) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("x", 9), ("y", 3)]


def test_passages_are_found_wherever_they_begin(spark):
    from lexgrove.operators.evals import passages_in

    texts = ["one two three four five six seven eight nine ten", "xone two three", "a\none two threes", "two", "tw o", "", None, "one  two three"]
    items = ["one two three", "one two three four five six seven eight nine ten", "two", "two three", "", None, "one", "ne two thr", "nine ten eleven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in passages_in(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), docs).collect())
    assert got == [(i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t]
