"""Answers, the strict verdict, evaluation, and the index as tables, on fixed cases."""

import json

import pytest

from lexgrove.operators import answers as A
from lexgrove.operators import evals as E
from lexgrove.operators.grounding import judge
from lexgrove.sources import tables as T

PROVISIONS = [
    ("mar:art1", "Art. 1º", ["Art. 1º"], "O farol acende ao pôr do sol.", False, False),
    ("mar:art1:incI", "I", ["Art. 1º", "I"], "no inverno, uma hora antes;", False, False),
    ("mar:art2", "Art. 2º", ["Art. 2º"], "", True, False),
]


@pytest.fixture(scope="module")
def provisions(spark):
    return spark.createDataFrame(PROVISIONS, "id string, label string, path array<string>, text string, revoked boolean, vetoed boolean")


def test_verdict(spark, provisions):
    long = "uma frase com seis palavras ou mais"
    blocks = [(1, 0, long), (1, 1, "Sim."), (2, 0, long), (2, 1, long), (3, 0, "Curto."), (4, 0, None), (5, 0, long)]
    cited = [(1, 0, "mar:art1", "acende ao pôr do sol"), (2, 0, "mar:art1", "isto não está lá"), (2, 1, "mar:art2", "qualquer coisa"), (5, 0, "mar:art1", "acende ao pôr do sol"), (5, 0, "malformed", "x")]
    got = judge(spark.createDataFrame(blocks, "answer long, block int, text string"), spark.createDataFrame(cited, "answer long, block int, id string, quote string"), provisions, "id").collect()
    by = {r.answer: (r.grounded, r.n_invalid, r.uncited_blocks, r.reasons) for r in got}
    none = "no valid citation"
    assert by[1] == (True, 0, [], []) and by[3] == by[4] == (False, 0, [], [none])
    assert by[2] == (False, 2, [0, 1], ["2 invalid citation(s)", "2 substantive block(s) without a valid citation", none])
    assert by[5] == (False, 1, [], ["1 invalid citation(s)"])


def test_prompts_and_answers(spark, provisions):
    hits = spark.createDataFrame([(q, i, r) for q in (1, 3, 4, 5, 6) for i, r in (("mar:art1:incI", 1), ("mar:art1", 2))], "qid long, id string, rank int")
    documents = A.prompt_documents(hits, provisions)
    first = documents.where("qid = 1 and index = 0").first()
    assert (first.id, first.title, first.context, first.text) == ("mar:art1:incI", "mar:art1:incI — Art. 1º > I", "Art. 1º > I\nArt. 1º: O farol acende ao pôr do sol.", "no inverno, uma hora antes;")
    asked = spark.createDataFrame([(1, "Quando \"acende\"?"), (9, None)], "qid long, text string")
    message = {r.qid: json.loads(r.message) for r in A.prompts(asked, documents).collect()}
    assert [c["type"] for c in message[1]["content"]] == ["document", "document", "text"] and message[1]["content"][2]["text"] == '<pergunta>\nQuando "acende"?\n</pergunta>'
    assert message[1]["content"][1]["source"]["content"][0]["text"] == "O farol acende ao pôr do sol." and message[9]["content"] == [{"type": "text", "text": "<pergunta>\n\n</pergunta>"}]

    blocks = spark.createDataFrame([(1, 0, "Ele acende antes no inverno, sempre."), (1, 1, " Fim."), (3, 0, "SEM_BASE "), (4, 0, "Não tem nenhuma fonte para tudo isto."), (5, 0, "cortad"), (7, 0, "x")], "qid long, block int, text string")
    raw = [(1, 0, 0, "content_block_location", 0, "uma hora antes"), (1, 0, 1, "content_block_location", 1, "acende ao pôr do sol"), (1, 1, 0, "content_block_location", 0, "no inverno, uma"), (4, 0, 0, "content_block_location", 9, "x"), (4, 0, 1, "page", 0, None)]
    cited = A.mapped(spark.createDataFrame(raw, "qid long, block int, n int, kind string, index int, quote string"), documents)
    assert sorted((r.qid, r.block, r.n, r.id) for r in cited.collect()) == [(1, 0, 0, "mar:art1:incI"), (1, 0, 1, "mar:art1"), (1, 1, 0, "mar:art1:incI"), (4, 0, 0, A.UNMAPPED), (4, 0, 1, A.UNMAPPED)]
    summary = spark.createDataFrame([(1, None), (2, "out_of_scope"), (3, None), (4, None), (5, None), (6, None), (7, None)], "qid long, refused string")
    stops = spark.createDataFrame([(5, "max_tokens"), (6, "refusal"), (1, "end_turn")], "qid long, stop string")
    out = A.answered(summary, hits, provisions, blocks, cited, stops)
    by = {r.qid: r for r in out.collect()}
    assert {q: r.refusal for q, r in by.items()} == {1: None, 2: "out_of_scope", 3: "model_no_support", 4: "ungrounded", 5: "truncated", 6: "model_refusal", 7: "low_score"}
    assert by[1].status == "answered" and by[1].cited == ["mar:art1:incI", "mar:art1"] and by[1].nearest == [] and by[1].message is None
    assert by[4].details[0] == "2 invalid citation(s)" and by[4].nearest == ["mar:art1:incI", "mar:art1"] and by[7].nearest == []
    text = {r.qid: r.text for r in A.rendered(out, blocks, cited, provisions).collect()}
    assert text[1].startswith("Ele acende antes no inverno, sempre. [1] [2] Fim. [1]\n\nFontes (texto oficial):\n[1] mar:art1:incI — Art. 1º > I\n    no inverno")
    assert text[7] == "Sem base no corpus: " + A.MESSAGES["low_score"] and "\n- mar:art1:incI — " in text[5]


def test_evaluation_counts_refusals(spark):
    items = spark.createDataFrame([(1, "dev", False), (2, "dev", False), (3, "dev", True), (4, "holdout", False)], "item_id long, split string, must_refuse boolean")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (4, "z")], "item_id long, id string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 6), (2, "a", 1), (3, "a", 1), (4, "y", 1)], "item_id long, id string, rank int")
    refusals = spark.createDataFrame([(1, None), (2, "low_score"), (3, "out_of_scope")], "item_id long, refused string")
    got = {r.split: tuple(r)[1:] for r in E.evaluation(items, expected, ranked, refusals).collect()}
    assert got["dev"] == (2, 1, 0.0, 0.25, 0.5, 0.5, 0.25, 1.0, 0.5)
    assert got["holdout"] == (1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0)
    assert got["all"] == (3, 1, 0.0, 0.1667, 0.3333, 0.3333, 0.1667, 1.0, 0.3333)


def test_generation_metrics(spark):
    kinds = "must_refuse boolean, answered boolean, recall double, input_tokens long, output_tokens long, latency double"
    rows = [(False, True, 0.5, 10, 1, 5.0), (False, False, None, 20, 2, 1.0), (True, False, None, None, None, 3.0), (True, True, None, 5, 5, 4.0), (False, True, None, 0, 0, 2.0)]
    assert tuple(E.generation_metrics(spark.createDataFrame(rows, kinds)).first()) == (3, 0.666667, 0.166667, 2, 0.5, 35, 8, 3.0, 4.0)
    assert tuple(E.generation_metrics(spark.createDataFrame([], kinds)).first()) == (0, 0.0, 0.0, 0, 0.0, 0, 0, 0.0, 0.0)
    assert [E.generation_metrics(spark.createDataFrame([(False, True, 1.0, 0, 0, float(i)) for i in range(n)], kinds)).first().latency_p95 for n in (1, 10, 21)] == [0.0, 8.0, 19.0]


def test_passages(spark):
    items = spark.createDataFrame([(1, "azul"), (2, "o mar azul"), (3, ""), (4, None), (5, "azul"), (6, "😀 x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "o mar azul"), (2, "azulado"), (2, "azul"), (3, None), (4, ""), (5, "a 😀 xy"), (None, "azul")], "doc_id long, text string")
    got = sorted((r.item_id, r.doc_id or 0) for r in E.passages_in(items, docs).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 1), (5, 0), (5, 1), (5, 2), (6, 5)]
    assert E.passages_in(items.limit(0), docs).count() == 0 and E.passages_in(items, docs.limit(0)).count() == 0


def test_tables_are_replaced_by_document(spark, tmp_path):
    home = str(tmp_path)
    T.create(spark, home)
    make = lambda name, rows: spark.createDataFrame(rows, T.TABLES[name])
    doc = lambda d, sha: (d, d, "law", "u", None, sha, "b", "hash-4", d)
    prov = lambda d, n: (f"{d}:art{n}", d, None, "article", f"Art. {n}", [f"Art. {n}"], "t", [], False, False, n, None, None)
    chunk = lambda d, n: (f"{d}:art{n}", "c", [1.0], d)
    T.replace_documents(spark, home, make("documents", [doc("a", "1"), doc("b", "1")]), make("provisions", [prov("a", 1), prov("a", 2), prov("b", 1)]), make("chunks", [chunk("a", 1), chunk("a", 2), chunk("b", 1)]))
    version = lambda d, seq: (f"{d}:art1", seq, "old", None, None, None, None, d)
    assert T.replace_versions(spark, home, make("provision_versions", [version("a", 0), version("a", 1)]), "a") == 2
    assert T.replace_versions(spark, home, make("provision_versions", [version("b", 0)]), "b") == 1
    assert T.replace_versions(spark, home, make("provision_versions", [version("a", 0)]), "a") == 1
    with pytest.raises(ValueError):
        T.replace_documents(spark, home, make("documents", [doc("a", "2")]), make("provisions", [prov("a", 1)]), make("chunks", [chunk("a", 1), chunk("a", 2)]))
    T.create(spark, home)
    assert tuple(T.health(spark, home).first()) == (2, 3, 3, "hash-4")
    T.replace_documents(spark, home, make("documents", [doc("a", "2")]), make("provisions", [prov("a", 7)]), make("chunks", []))
    ids = lambda name, c: sorted(r[0] for r in T.read(spark, home, name).select(c).collect())
    assert ids("provisions", "id") == ["a:art7", "b:art1"] and ids("chunks", "provision_id") == ["b:art1"] and ids("provision_versions", "provision_id") == ["b:art1"]
    assert sorted((r.id, r.source_sha256) for r in T.read(spark, home, "documents").collect()) == [("a", "2"), ("b", "1")]
