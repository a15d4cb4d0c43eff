"""Chunks, propagation, reranking and the whole search, on a small act."""

from dataclasses import replace

import pytest

from lexgrove.operators.retrieval import Tuning, build_index, propagate, rerank, search, shared_terms
from lexgrove.operators.structure import parse

ACT = ["CAPÍTULO I", "DO TRATAMENTO", "Art. 7º O tratamento de dados pessoais será realizado:", "I - mediante consentimento do titular;", "II - para cumprimento de obrigação legal;", "Art. 8º Os dados de crianças exigem cuidado.", "§ 1º (Revogado)", "Art. 9º Multa de dois por cento."]
QUESTIONS = [(1, "O que diz o art. 7º, II, da LGPD?"), (2, "art. 99 da LGPD"), (3, "multa no GDPR"), (4, "consentimento do titular"), (5, "art. 8º, § 1º"), (6, None), (7, "zzz qqq")]


@pytest.fixture(scope="module")
def index(spark):
    lines = spark.createDataFrame([("lgpd", n, x) for n, x in enumerate(ACT, 1)], "document_id string, line_no long, line string")
    names = spark.createDataFrame([("lgpd", "LGPD")], "document_id string, short_name string")
    made = build_index(parse(lines).cache(), names, 64)
    return replace(made, chunks=made.chunks.cache(), posted=made.posted.cache(), vectors=made.vectors.cache())


def test_chunks(index):
    got = {r.id: r.content for r in index.chunks.collect()}
    assert got["lgpd:art7:incI"] == "LGPD > CAPÍTULO I — DO TRATAMENTO > Art. 7º > I\nO tratamento de dados pessoais será realizado:\nmediante consentimento do titular;"
    assert got["lgpd:art9"].endswith("Art. 9º\nMulta de dois por cento.") and "lgpd:art8:par1" not in got


@pytest.mark.parametrize("mode", ["hybrid", "lexical", "dense"])
def test_search(spark, index, mode):
    questions = spark.createDataFrame(QUESTIONS, "qid long, text string")
    hits, summary = search(questions, index, Tuning(k=3, threshold=0.05), mode, shared_terms)
    s = {r.qid: r for r in summary.collect()}
    ranked = {}
    for r in hits.orderBy("qid", "rank").collect():
        ranked.setdefault(r.qid, []).append(r)
    assert ranked[1][0].id == "lgpd:art7:incII" and ranked[1][0].explicit and ranked[1][0].score == 1.0 and s[1].refused is None
    assert s[2].refused == "nonexistent_provision" and s[2].missing == ["lgpd:art99"]
    assert s[3].refused == "out_of_scope" and s[3].acts == ["GDPR"]
    assert "lgpd:art7:incI" in [r.id for r in ranked[4]] and not any(r.explicit for r in ranked[4])
    assert s[5].explicit == [] and s[5].missing == []  # revoked: neither named nor missing
    assert 6 not in ranked and s[6].refused == "low_score"
    assert all([r.rank for r in rows] == list(range(1, len(rows) + 1)) for rows in ranked.values())
    if mode == "lexical":
        assert s[4].best is None and s[4].refused == "low_score" and 7 not in ranked


def test_propagation_adds_ancestors_and_keeps_order(spark):
    known = spark.createDataFrame([("x:art1",), ("x:art1:par1",), ("x:art1:par1:incI",), ("x:art2",)], "id string")
    fused = spark.createDataFrame([(1, "x:art1:par1:incI", 0.5, 1), (1, "x:art2", 0.5, 2), (1, "y:art1:incI", 0.1, 3)], "qid long, id string, score double, rank int")
    got = [(r.id, r.score) for r in propagate(fused, known, 0.2).orderBy("rank").collect()]
    assert got == [("x:art1:par1:incI", 0.5), ("x:art2", 0.5), ("y:art1:incI", 0.1), ("x:art1:par1", 0.1), ("x:art1", 0.02)]


def test_rerank_orders_by_position(spark):
    ranked = spark.createDataFrame([(1, "e", 1.0, 1, True), (1, "a", 0.9, 2, False), (1, "n", 0.8, 3, False), (1, "b", 0.7, 4, False), (1, "t", 0.6, 5, False)], "qid long, id string, score double, rank int, explicit boolean")
    made = spark.createDataFrame([("a", "nothing"), ("b", "fee levels"), ("t", "fee levels")], "id string, content string")
    out = rerank(ranked, spark.createDataFrame([(1, "fee levels")], "qid long, text string"), made, shared_terms, 4).orderBy("rank").collect()
    tie = round(1 / 61 + 1 / 62, 6), round(1 / 63 + 1 / 61, 6)
    assert [(r.id, r.score) for r in out] == [("e", 1.0), ("a", tie[0]), ("b", tie[1]), ("n", 0.0), ("t", round(1 / 65, 6))]
