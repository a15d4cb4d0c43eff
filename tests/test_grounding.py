from lexgrove.operators.grounding import check_citations

CORPUS = [
    ("x:art1", "Esta Lei dispõe sobre o tratamento de dados — “pessoais” no Brasil", False, False),
    ("x:art2", "", True, False),
    ("x:art3", "", False, True),
    ("x:art4", None, None, None),
]
CITED = [
    ("x:art1:inc9", "qualquer coisa aqui", "malformed"),
    ("x:art1\n", "tratamento de dados", "malformed"),
    (None, "tratamento de dados", "malformed"),
    ("x:art9", "tratamento de dados", "unknown"),
    ("x:art2", "texto revogado qualquer", "revoked"),
    ("x:art2", "curto", "revoked"),
    ("x:art3", "texto vetado qualquer", "vetoed"),
    ("x:art1", "'Esta Lei.'", "too_short"),
    ("x:art1", None, "too_short"),
    ("x:art1", "tratamento de documentos", "not_found"),
    ("x:art1", "Tratamento de dados", "not_found"),
    ("x:art4", "tratamento de dados", "not_found"),
    ("x:art1", 'tratamento  de dados - "pessoais" no', None),
    ("x:art1", "“tratamento de dados – „pessoais” no Brasil.”", None),
    ("x:art1", "dispõe sobre o tratamento", None),
]


def test_citations_have_the_first_of_six_outcomes(spark):
    corpus = spark.createDataFrame(CORPUS, "id string, text string, revoked boolean, vetoed boolean")
    cited = spark.createDataFrame([(n, *c) for n, c in enumerate(CITED)], "n int, id string, quote string, expected string")
    out = check_citations(cited, corpus, "id")
    assert out.columns == ["n", "id", "quote", "expected", "known_id", "issue"]
    assert [(r.n, r.issue) for r in out.orderBy("n").collect()] == [(n, c[2]) for n, c in enumerate(CITED)]


def test_keys_that_are_no_strings_have_no_grammar_and_corpora_may_lack_flags(spark):
    cited = spark.createDataFrame([(1, "one two three."), (2, "one two three")], "doc_id long, quote string")
    corpus = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    assert {r.doc_id: r.issue for r in check_citations(cited, corpus, "doc_id").collect()} == {1: None, 2: "unknown"}
