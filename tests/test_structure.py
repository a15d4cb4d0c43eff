"""The structural parser, identifiers and references in questions, on fixed cases."""

import pytest
from pyspark.sql import functions as F

from lexgrove.functions.grammar import find_references, format_id, other_acts, parse_id, place, roman, roman_number
from lexgrove.operators.structure import NODES, outline, parse
from lexgrove.sources.html import page_blocks

NAMES = [c.split()[0] for c in NODES.split(", ")]


def tree(lines, document="x"):
    return {r["id"]: r for r in (dict(zip(NAMES, t)) for t in outline(document, lines))}


def lines_of(html):
    return [line for line, struck in page_blocks(html) if not struck]


def test_labels_parents_and_paths():
    t = tree(["LEI Nº 1", "CAPÍTULO I", "DISPOSIÇÕES", "Art. 2o Texto", "e mais.", "I - um;", "a) dois:", "1. três;", "b) quatro.", "§ 2° Outro.", "IX – fim.", "Parágrafo único. Só.", "Art. 10-J. Dez."])
    ids = ["x:art2", "x:art2:incI", "x:art2:incI:alia", "x:art2:incI:alia:item1", "x:art2:incI:alib", "x:art2:par2", "x:art2:par2:incIX", "x:art2:paru", "x:art10J"]
    assert list(t) == ids and [r["ordinal"] for r in t.values()] == list(range(9))
    assert t["x:art2"]["text"] == "Texto e mais." and t["x:art2"]["start_line"] == 4 and t["x:art2"]["parent_id"] is None
    assert t["x:art2:par2:incIX"]["path"] == ["CAPÍTULO I — DISPOSIÇÕES", "Art. 2º", "§ 2º", "IX"]
    assert t["x:art2:incI:alib"]["parent_id"] == "x:art2:incI" and t["x:art10J"]["label"] == "Art. 10-J"


def test_notes_revocations_and_vetoes():
    t = tree(["Art. 7º Texto:", "§ 2º (Revogado). (Redação dada pela Lei nº 13.853, de 2019) Vigência", "§ 3º (VETADO). (Incluído pela Lei nº 13.853, de 2019) Vigência", "§ 4º Em vigor. (Redação dada pela Lei nº 13.853, de 2019) Vigência", "§ 5º", "(Revogado pela Lei nº 1)", "Art. 35. Caput.", "(Revogado pela Resolução nº 4)", "I-A – dia 1º; (Incluído pela Lei nº 2) (Convertida na Lei nº 3)"])
    flags = {i: (r["text"], r["revoked"], r["vetoed"]) for i, r in t.items()}
    assert flags == {"x:art7": ("Texto:", False, False), "x:art7:par2": ("", True, False), "x:art7:par3": ("", False, True), "x:art7:par4": ("Em vigor.", False, False), "x:art7:par5": ("", True, False), "x:art35": ("Caput.", False, False), "x:art35:incI-A": ("dia 1º;", False, False)}
    assert t["x:art35"]["amendments"] == [] and t["x:art35:incI-A"]["amendments"] == ["(Incluído pela Lei nº 2)", "(Convertida na Lei nº 3)"]


def test_quotations_signatures_and_the_end():
    t = tree(["Art. 2º O art. 14 passa a vigorar:", '"Art. 14. ..........', "............", "II - novo", '........" (NR)', "Art. 3º Vige.", "MARIA DA SILVA", "Diretora-Presidente", "CAPÍTULO IX", "(Redação dada pela Lei nº 15)", "DA AGÊNCIA’", "Art. 55-A.. Novo.", "Brasília , 14 de agosto", "Art. 99. Fora"], "r")
    assert list(t) == ["r:art2", "r:art3", "r:art55A"]
    assert t["r:art2"]["text"] == 'O art. 14 passa a vigorar: "Art. 14. (...) II - novo (...) " (NR)'
    assert t["r:art3"]["text"] == "Vige." and t["r:art55A"]["path"] == ["CAPÍTULO IX — DA AGÊNCIA", "Art. 55-A"] and t["r:art55A"]["text"] == "Novo."


def test_annexes_and_rubrics():
    t = tree(["Art. 1º Aprovar.", "ANEXO I", "REGULAMENTO", "Objeto da atuação", "Art. 1º Um.", "Intimação", "Art. 2º Dois.", "Seção I", "Da Seção", "Art. 3º Três", "na linha;", "Art. 4º Quatro.", "ANEXO II - CLÁUSULAS", "Art. 1º Último."], "r")
    assert list(t) == ["r:art1", "r:anx1:art1", "r:anx1:art2", "r:anx1:art3", "r:anx1:art4", "r:anx2:art1"]
    assert t["r:anx1:art1"]["path"] == ["Anexo I — REGULAMENTO", "Objeto da atuação", "Art. 1º"] and t["r:anx1:art1"]["text"] == "Um."
    assert t["r:anx1:art2"]["path"][-2:] == ["Intimação", "Art. 2º"]
    assert t["r:anx1:art3"]["path"] == ["Anexo I — REGULAMENTO", "Seção I — Da Seção", "Art. 3º"] and t["r:anx1:art3"]["text"] == "Três na linha;"
    assert t["r:anx2:art1"]["path"] == ["Anexo II — CLÁUSULAS", "Art. 1º"]


def test_pages_become_trees():
    page = "<p>Art. 5<span>\n7.</span> (VETADO).</p><p>Art. 9º Simples. Parágrafo único. A fonte.</p><p>Art. 10. O art. 5º passa: “Art. 5º Novo. Parágrafo único. Outro.” (NR)</p><p>Art. 35. Caput.</p><p><del>§ 4º Velho.</del> (Revogado pela Lei nº 4)</p>"
    t = tree(lines_of(page))
    assert list(t) == ["x:art57", "x:art9", "x:art9:paru", "x:art10", "x:art35"] and t["x:art57"]["vetoed"] and not t["x:art35"]["revoked"]
    assert t["x:art9"]["text"] == "Simples." and t["x:art9:paru"]["text"] == "A fonte."


def test_parse_over_many_documents(spark):
    rows = [(d, n, text) for d in ("a", "b") for n, text in enumerate(["Art. 1º Um.", None, "", "§ 1º Dois.", "Art. 1º De novo."], 1)] + [(None, 1, "Art. 1º"), ("c", 1, "nada")]
    lines = spark.createDataFrame(rows, "document_id string, line_no long, line string")
    out = sorted((r.id, r.ordinal, r.error) for r in parse(lines).collect())
    assert out == [x for d in ("a", "b") for x in [(f"{d}:art1", 0, None), (f"{d}:art1", 2, f"duplicate provision {d}:art1"), (f"{d}:art1:par1", 1, None)]]
    assert parse(lines.limit(0)).count() == 0


def test_identifiers(spark):
    good = ["lgpd:art1", "res-anpd-1-2021:anx1:art2:par3:incIX:alib:item2", "lgpd:art55J:paru:incI-A"]
    bad = ["lgpd", "LGPD:art1", "x:anx0:art1", "x:art1:incI:par1", "x:art", ""]
    df = spark.createDataFrame([(i,) for i in good + bad], "id string").withColumn("p", parse_id(F.col("id")))
    got = {r.id: r.back for r in df.select("id", F.when(F.col("p").isNotNull(), format_id(F.col("p"))).alias("back")).collect()}
    assert got == {**{i: i for i in good}, **{i: None for i in bad}}
    assert [place(i).id() for i in good] == good and not any(place(i) for i in bad)
    assert all(roman_number(roman(n)) == n for n in range(1, 4000)) and roman_number("IIII") is roman_number("") is None


REFERENCES = {
    "O que diz o art. 7º, inciso IX, da LGPD?": ["lgpd:art7:incIX"],
    "artigo 7, IX": ["lgpd:art7:incIX"],
    "Art. 48, § 1º, III": ["lgpd:art48:par1:incIII"],
    "art. 11, II, alínea g": ["lgpd:art11:incII:alig"],
    'art. 11, II, "g"': ["lgpd:art11:incII:alig"],
    "art. 24, parágrafo único": ["lgpd:art24:paru"],
    "art. 55-J, IV": ["lgpd:art55J:incIV"],
    "art. 65, I-A": ["lgpd:art65:incI-A"],
    "Compare o art. 7º e o art. 11": ["lgpd:art7", "lgpd:art11"],
    "art. 7º, IX e X": ["lgpd:art7:incIX"],
    "art. 6 da Resolução CD/ANPD nº 15/2024": ["res-anpd-15-2024:anx1:art6", "res-anpd-15-2024:art6"],
    "Resolução CD/ANPD nº 18, de 16 de julho de 2024, art. 3": ["res-anpd-18-2024:anx1:art3", "res-anpd-18-2024:art3"],
    "Quais são os direitos do titular?": [],
    "art. 31, § 1º, da Lei de Acesso à Informação": ["lai:art31:par1"],
    "Lei nº 12.527/2011, art. 4º, IV": ["lai:art4:incIV"],
    "art. 23 da lei 12527": ["lai:art23"],
    None: [],
}
ACTS = {"multa no GDPR?": ["GDPR"], "furto no Código  Penal?": ["Código Penal"], "art. 5º da Constituição Federal": ["Constituição Federal"], "a LGPD e o GDPR": [], "A LAI e o Marco Civil da Internet": [], "dado sensível?": [], None: []}


def test_references_in_questions(spark):
    df = spark.createDataFrame([(q,) for q in REFERENCES], "q string").select("q", F.flatten(find_references(F.col("q"))).alias("r"))
    assert {r.q: r.r for r in df.collect()} == REFERENCES
    assert {r.q: r.a for r in spark.createDataFrame([(q,) for q in ACTS], "q string").select("q", other_acts(F.col("q")).alias("a")).collect()} == ACTS


def test_batches_keep_their_limits(spark):
    from lexgrove.operators.batches import token_batches

    rows = spark.createDataFrame([(i, "x" * (i * 37 % 3000)) for i in range(500)] + [(500, "y" * 60000), (501, None)], "k long, t string")
    groups = {}
    for r in token_batches(rows, "k", "t").collect():
        groups.setdefault((r.part, r.batch), []).append(r)
    assert sum(map(len, groups.values())) == 502
    assert all(len(g) <= 64 and (sum(r.tokens for r in g) <= 8000 or len(g) == 1) for g in groups.values())
    assert {r.id: r.tokens for g in groups.values() for r in g if r.id > 499} == {500: 20001, 501: 1}
