"""Files of a corpus, its checks, reports and the watch."""

import json
from datetime import date

from pyspark.sql import functions as F

from lexgrove.operators import reports as R
from lexgrove.operators.structure import parse
from lexgrove.sources import corpus as C
from lexgrove.streaming.watch import watch

SHA = "a" * 64


def provisions(spark, lines, document="lgpd"):
    rows = spark.createDataFrame([(document, n, x) for n, x in enumerate(lines, 1)], "document_id string, line_no long, line string")
    return parse(rows).drop("error", "start_line").withColumns({c: F.lit(None).cast("date") for c in ("valid_from", "valid_to")})


def test_yaml_keeps_its_comments(spark, tmp_path):
    path = tmp_path / "acts.yaml"
    path.write_text("# about\n# this\nacts:\n- name: Lei B\n  dou_date: 2019-07-09\n- name: Lei A\n", encoding="utf-8")
    acts = C.read_yaml(spark, str(path), "acts", "name string, dou_date date")
    assert sorted((r.name, r.dou_date) for r in acts.collect()) == [("Lei A", None), ("Lei B", date(2019, 7, 9))]
    C.write_yaml(acts, str(path), "acts", "name")
    assert path.read_text(encoding="utf-8").startswith("# about\n# this\nacts:\n- name: Lei A\n- name: Lei B\n")
    assert C.read_yaml(spark, str(path), "none", "name string").count() == 0


def test_documents_and_histories_round_trip(spark, tmp_path):
    p = provisions(spark, ["Art. 1º Um.", "§ 1º Dois.", "Art. 2º (VETADO)"]).cache()
    docs = spark.createDataFrame([("lgpd", "LGPD", "law", "u", date(2026, 1, 1), SHA, "b"), ("lai", "LAI", "law", "u", None, "b" * 64, "b")], C.DOCUMENT.split(", provisions")[0])
    C.write_documents(docs, p, f"{tmp_path}/d")
    manifest = spark.createDataFrame([("lgpd", SHA), ("lai", SHA)], "id string, source_sha256 string")
    back = C.read_documents(spark, f"{tmp_path}/d", manifest)
    assert {r.id: r.state for r in back.collect()} == {"lgpd": "current", "lai": "stale"}
    assert sorted(map(str, C.provisions_of(back).collect())) == sorted(map(str, p.select(*C.provisions_of(back).columns).collect()))
    for doc, sha in (("lgpd", SHA), ("lai", SHA)):
        (tmp_path / f"{doc}.json").write_text(json.dumps({"document_id": doc, "source_sha256": sha, "provisions": [{"provision_id": f"{doc}:art1", "versions": [{"text": "a"}, {"text": "b", "valid_from": "2020-01-01"}]}]}, indent=1))
    v = C.read_versions(spark, f"{tmp_path}/*.json", docs)
    assert sorted((r.id, r.seq, r.text, r.valid_from) for r in v.collect()) == [("lgpd:art1", 1, "a", None), ("lgpd:art1", 2, "b", date(2020, 1, 1))]


def test_vectors_meta_and_rules(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0]), ("c", [1.0])], "id string, v array<float>")
    C.save_vectors(v, f"{tmp_path}/v", "m", SHA)
    saved, want = spark.read.parquet(f"{tmp_path}/v"), spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    assert {r.id: r.problem for r in C.check_vectors(saved, want, SHA, 1).collect()} == {"b": "dimension", "c": "unexpected", "d": "missing"}
    assert {r.problem for r in C.check_vectors(saved, saved, "x", 1).collect()} == {"stale"}
    assert {r.id: r.v for r in C.first_vectors(want, v.where("id = 'a'"), v).collect()} == {"a": [1.0], "b": [1.0, 2.0], "d": None}
    chunks = spark.createDataFrame([("1", "x", SHA), ("2", "y", SHA)], "id string, document_id string, source_sha256 string")
    indexed = spark.createDataFrame([("x", SHA, "m"), ("y", SHA, "other")], "id string, source_sha256 string, model string")
    assert [r.id for r in C.to_embed(chunks, indexed, "m").collect()] == ["2"]
    meta = spark.createDataFrame([("model", "a", 1), ("model", "b", 2)], "key string, value string, at int")
    assert [tuple(r) for r in C.latest_meta(meta).collect()] == [("model", "b")]
    rows = [("d:art1", "d", None, 0), ("d:art1", "d", None, 1), ("d:art2:par1", "d", "d:art2", 2), ("D", "d", None, 3), ("e:art1", "d", None, -1), (None, None, None, None)]
    bad = {tuple(r) for r in C.violations(spark.createDataFrame(rows, "id string, document_id string, parent_id string, ordinal int")).collect()}
    assert bad == {("duplicate", "d:art1"), ("orphan", "d:art2:par1"), ("malformed", "D"), ("foreign", "D"), ("foreign", "e:art1"), ("ordinal", "e:art1"), ("malformed", None), ("foreign", None), ("ordinal", None)}


def test_reports(spark):
    rows = spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5)], "n int, name string, x double")
    assert R.markdown(rows, ["name", "x"], "n").first().text == "| name | x |\n|---|---|\n| a | 0.5 |\n| b\\|c | – |"
    assert json.loads(rows.where("n = 1").select(R.badge(F.col("x"), "recall", 0.7, 0.5).alias("b")).first().b) == {"schemaVersion": 1, "label": "recall", "message": "50.0 %", "color": "yellow"}
    page = R.act_pages(provisions(spark, ["Art. 1º a <b> & c", "Art. 2º (VETADO)"])).first()
    assert page.in_force == 1 and page.html.split("\n") == ['<p id="lgpd:art1"><b>Art. 1º</b> a &lt;b&gt; &amp; c</p>', '<p id="lgpd:art2"><b>Art. 2º</b> <em>vetado</em> </p>']
    assert [r.metric for r in R.failed_gates(spark.createDataFrame([(0.6, 0.9, None)], "a double, b double, c double"), {"a": 0.7, "b": 0.7, "c": 0.1}).collect()] == ["a", "c"]
    one = spark.createDataFrame([("d", "d:art1", "changed", "x" * 700, "~~~")], "document_id string, id string, change string, old string, new string")
    value = R.change_entries(one).first().value
    assert value.startswith("### d:art1 (changed)\n\n~~~text\n" + "x" * 600 + "…\n~~~\n\n") and value.endswith("~~~text\n~ ~ ~\n~~~")


def test_watch(spark, tmp_path):
    state, log, land = (f"{tmp_path}/{x}" for x in ("state", "log", "land"))
    land_it = lambda df: df.coalesce(1).write.mode("append").parquet(land)
    first = provisions(spark, ["Art. 1º Um.", "Art. 2º Dois."])
    land_it(first)
    run = lambda: watch(spark.readStream.schema(first.schema).parquet(land), state, log, f"{tmp_path}/ck").awaitTermination(120)
    run()
    land_it(provisions(spark, ["Art. 1º Um.", "Art. 2º Outro.", "Art. 3º Três."]).where("ordinal > 0"))
    land_it(provisions(spark, ["Art. 1º Lai."], "lai"))
    run()
    got = {(r.batch, r.id): r.change for r in spark.read.parquet(log).collect()}
    assert got == {(0, "lgpd:art1"): "added", (0, "lgpd:art2"): "added", (1, "lgpd:art1"): "removed", (1, "lgpd:art2"): "changed", (1, "lgpd:art3"): "added", (1, "lai:art1"): "added"}
    assert {r.id for r in spark.read.parquet(state).collect()} == {"lgpd:art2", "lgpd:art3", "lai:art1"}
