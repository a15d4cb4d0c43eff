import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import search as S
from lexgrove.queries import ORACLE_SQL, QUERIES
from tests.oracle import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found, expected = rows_of(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert found == expected


def test_text_functions(spark):
    row = spark.createDataFrame([("Não é o Art. 5º  da LEI", "111.444.777-35")], "a string, b string")
    out = row.select(
        T.or_terms(F.col("a")).alias("terms"),
        T.clip(F.lit("one two three"), 9).alias("clip"),
        T.valid_cpf(F.lit("11144477735")).alias("cpf"),
        T.valid_cpf(F.lit("11111111111")).alias("same"),
        T.valid_cnpj(F.lit("11222333000181")).alias("cnpj"),
        T.covers(F.lit("a:b"), F.lit("a:b:c")).alias("covers"),
        T.covers(F.lit("a:b"), F.lit("a:bc")).alias("not_covers"),
        T.roman_value(F.lit("XLIV")).alias("roman"),
        T.normalize_for_match(F.lit(" “a”  –  b ")).alias("norm"),
    ).first()
    assert out.terms == ["nao", "art", "5o", "da", "lei"]
    assert (out.clip, out.cpf, out.same, out.cnpj, out.covers, out.not_covers, out.roman, out.norm) == ("one two…", True, False, True, True, False, 44, '"a" - b')


def test_rrf_is_weighted_and_ties_go_by_best_rank_then_id(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid long, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "qid long, id string, rank int")
    out = {r.id: (r.score, r.best) for r in S.rrf([(a, 1.0), (b, 1.0)]).collect()}
    assert out["x"] == out["y"] == (round(1 / 61 + 1 / 62, 6), 1)
    with pytest.raises(ValueError):
        S.rrf([(a, 1.0)], k=0)


def test_top_k_uses_window_group_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for ranked in (S.cover_density(spark.read.parquet(f"{SF}/benchmark.parquet"), S.postings(docs), 0, 10), S.bm25(spark.read.parquet(f"{SF}/benchmark.parquet"), S.postings(docs), 10)):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        # The only shuffle is that of each task's best, by question.
        assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and plan.count("Exchange ") == plan.count("Exchange hashpartitioning(qid") == 1


def test_rrf_counts_a_repeated_document_once_at_its_first_rank(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "qid long, id string, rank int")
    assert {r.id: r.score for r in S.rrf([(a, 2.0)]).collect()} == {"x": round(2 / 61, 6), "y": round(2 / 62, 6)}


def test_lexical_cases(spark):
    """Nulls, empty texts, terms that none has, repeated questions, ties, combined flags, and lots of one question."""
    docs = spark.createDataFrame([(1, "mar azul mar"), (2, "Mar, calmo"), (3, None), (4, ""), (None, "mar"), (5, "mar calmo")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "o mar calmo"), (8, None), (9, ""), (10, "floresta"), (11, "a"), (12, "mar")], "item_id long, text string")
    rows = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    posted = S.postings(docs)
    flat = rows(S.cover_density(asked, posted, 0, 2))
    assert flat == [(7, 1, 1, 0.2), (7, 2, 2, 0.2), (12, 1, 1, 0.2), (12, 2, 2, 0.1)]
    import math

    both = {(r[0], r[2]): r[3] for r in rows(S.cover_density(asked, posted, 1 | 8 | 32, 9))}
    raw = 0.2 / (1 + math.log(3)) / 2
    assert both[12, 1] == round(raw / (raw + 1), 6) and (12, 5) in both and len(both) == 6
    one = rows(S.bm25(asked, posted, 9))
    S.LOT_QUESTIONS, kept = 1, S.LOT_QUESTIONS
    try:
        assert rows(S.bm25(asked, posted, 9)) == one and rows(S.cover_density(asked, posted, 0, 2)) == flat
    finally:
        S.LOT_QUESTIONS = kept
    assert rows(S.cover_density(asked.limit(0), posted, 4, 5)) == [] and rows(S.bm25(asked, posted.limit(0), 5)) == []
