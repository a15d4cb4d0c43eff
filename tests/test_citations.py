"""Cross-references, from the rules in the module: sentences made for these tests, about invented acts and the three that have names."""

import pytest

from lexgrove.functions.citations import links_in, regulation_titles
from lexgrove.functions.grammar import Place, acts_outside, references
from lexgrove.functions.phrases import Phrase, tokens
from lexgrove.operators.crossrefs import edges

HERE = "lei-dos-farois:art20:par3:incIV:alib"
TITLES = regulation_titles([("res-anpd-90-2031", "1", "Anexo — REGULAMENTO DE GUARDA E LIMPEZA DE FARÓIS COSTEIROS"), ("res-anpd-91-2031", "2", "REGULAMENTO DA PESCA NOTURNA EM BAÍAS"), ("x", "1", "Anexo — QUADRO DE TARIFAS")])


def linked(text, here=HERE):
    return {text[a:b]: t for a, b, t in links_in(here, text, TITLES)}


#: What is left out comes from the citing provision: what stands above the highest level that is named.
RELATIVE = [
    ("a taxa do art. 31 dobra", {"art. 31": ["lei-dos-farois:art31"]}),
    ("salvo o § 5º, que dispensa aviso", {"§ 5º": ["lei-dos-farois:art20:par5"]}),
    ("como no inciso II se lê", {"inciso II": ["lei-dos-farois:art20:par3:incII", "lei-dos-farois:art20:incII"]}),
    ("só na alínea “d” cabe recurso", {"alínea “d”": ["lei-dos-farois:art20:par3:incIV:alid"]}),
    ("o caput deste artigo vale no inverno", {"caput deste artigo": ["lei-dos-farois:art20"]}),
    ("o inciso VII deste artigo vale no verão", {"inciso VII deste artigo": ["lei-dos-farois:art20:incVII"]}),
    ("o inciso VII deste parágrafo não vale", {"inciso VII deste parágrafo": ["lei-dos-farois:art20:par3:incVII"]}),
    ("cumprido o parágrafo único do art. 8º-C, acende-se a luz", {"parágrafo único do art. 8º-C": ["lei-dos-farois:art8C:paru"]}),
    ("a alínea c do inciso I-A do § 2º do art. 44 desta Lei rege o óleo", {"alínea c do inciso I-A do § 2º do art. 44 desta Lei": ["lei-dos-farois:art44:par2:incI-A:alic"]}),
]

LISTS = [
    ("valem os arts. 3º, 9º e 27 em maré alta", {"arts. 3º": ["lei-dos-farois:art3"], "9º": ["lei-dos-farois:art9"], "27": ["lei-dos-farois:art27"]}),
    ("os incisos I a III do art. 6º", {"incisos I": ["lei-dos-farois:art6:incI"], "III do art. 6º": ["lei-dos-farois:art6:incIII"]}),
    ("as alíneas 'e' ou 'f' do inciso X do art. 2º", {"alíneas 'e'": ["lei-dos-farois:art2:incX:alie"], "'f' do inciso X do art. 2º": ["lei-dos-farois:art2:incX:alif"]}),
    ("os §§ 1º e 2º dos arts. 5º e 6º", {}),
]

NAMED = [
    ("o art. 60 da LGPD rege o cadastro", {"art. 60 da LGPD": ["lgpd:art60"]}),
    ("conforme o art. 17, § 1º, da Lei Geral de Proteção de Dados Pessoais, avisa-se", {"art. 17, § 1º, da Lei Geral de Proteção de Dados Pessoais": ["lgpd:art17:par1"]}),
    ("segue-se o art. 32 da Lei nº 12.527, de 18 de novembro de 2011, ao pé da letra", {"art. 32 da Lei nº 12.527, de 18 de novembro de 2011": ["lai:art32"]}),
    ("veja o art. 4º da Resolução CD/ANPD nº 77, de 3 de março de 2030", {"art. 4º da Resolução CD/ANPD nº 77, de 3 de março de 2030": ["res-anpd-77-2030:art4", "res-anpd-77-2030:anx1:art4"]}),
    ("o art. 4º do Anexo II da Resolução CD/ANPD nº 77, de 2030, muda", {"art. 4º do Anexo II da Resolução CD/ANPD nº 77, de 2030": ["res-anpd-77-2030:anx2:art4"]}),
    ("aplica-se o art. 12 do Regulamento de Guarda e Limpeza aos cais", {"art. 12 do Regulamento de Guarda e Limpeza": ["res-anpd-90-2031:anx1:art12"]}),
    ("aplica-se o art. 1º do Regulamento da Pesca Noturna em Baías também", {"art. 1º do Regulamento da Pesca Noturna em Baías": ["res-anpd-91-2031:anx2:art1"]}),
]

ELSEWHERE = ["o art. 70 da Lei nº 8.888, de 2 de maio de 1990", "o art. 5º da Constituição", "o art. 9º do Regulamento dos Portos Fluviais Interiores", "o § 4º do art. 2º do Decreto nº 33", "o inciso I do art. 13 da referida norma", "art. sem número", "arts 4 e 5"]


@pytest.mark.parametrize(("text", "expected"), RELATIVE + LISTS + NAMED + [(t, {}) for t in ELSEWHERE])
def test_links(text, expected):
    assert linked(text) == expected


def test_a_named_act_needs_an_article_and_a_letter_alone_an_item():
    assert linked("o § 1º da LGPD") == {} and linked("a alínea “a”", "lei-dos-farois:art20:par3") == {}
    assert linked("o § 6º desta Resolução", "res-anpd-77-2030:anx1:art3") == {}
    assert linked("o art. 6º desta Resolução", "res-anpd-77-2030:anx1:art3") == {"art. 6º desta Resolução": ["res-anpd-77-2030:art6"]}


def test_the_act_at_the_end_holds_for_all_of_an_enumeration():
    assert [t for t in linked("cabe o art. 10, caput, o art. 11, inciso V, e o art. 12, conforme o caso, da LGPD").values()] == [["lei-dos-farois:art10"], ["lei-dos-farois:art11:incV"], ["lgpd:art12"]]
    assert [t for t in linked("cabe art. 10, caput, art. 11, inciso V, e art. 12, conforme o caso, da LGPD").values()] == [["lgpd:art10"], ["lgpd:art11:incV"], ["lgpd:art12"]]
    assert linked("pelos arts. 1º e 2º, art. 3º e art. 4º da Lei nº 8.888, de 1990") == {}


def test_an_article_holds_for_what_an_enumeration_adds_to_it():
    assert linked("nos termos do art. 15, § 2º, e § 4º da LGPD") == {"art. 15, § 2º": ["lgpd:art15:par2"], "§ 4º da LGPD": ["lgpd:art15:par4"]}


def test_nothing_within_a_quoted_amendment():
    text = "O art. 3º da LGPD passa a vigorar com a seguinte redação: “Art. 3º (...) II - no art. 9º”"
    assert linked(text) == {"art. 3º da LGPD": ["lgpd:art3"]}
    assert linked("fica acrescida do seguinte parágrafo: “§ 9º O art. 2º cai.”") == {}
    assert len(linked("fica acrescida do seguinte " + "longo " * 20 + ": o art. 2º cai")) == 1


@pytest.mark.parametrize("text", ["", None, "Nada consta.", "art.", "§", "alíneas"])
def test_texts_without_references(text):
    assert links_in(HERE, text, TITLES) == [] and links_in("Not An Id", "o art. 1º", TITLES) == []


def test_titles_that_more_than_one_regulation_begins_with_name_none():
    titles = regulation_titles([("a", "1", "REGULAMENTO DE USO DE BOIAS"), ("b", "1", "REGULAMENTO DE USO DE BARCOS")])
    assert links_in(HERE, "o art. 1º do Regulamento de Uso de Boias", titles) == []


def test_edges_go_to_the_first_that_exists_and_never_to_oneself(spark):
    rows = [("farol:art5:par2", "o inciso III e o art. 90"), ("farol:art5:incIII", "x"), ("farol:art6", "o art. 6º desta Lei e o art. 5º, inciso III"), ("farol:art7", None), (None, "art. 6º")]
    out = {(r.source, r.start, r.target) for r in edges(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert out == {("farol:art5:par2", 2, "farol:art5:incIII"), ("farol:art6", 24, "farol:art5:incIII")}


def test_phrases():
    read = lambda p, t: (f := next(Phrase(p).search(tokens(t)), None)) and (t[tokens(t)[f.first].start : tokens(t)[f.after - 1].end], f.values)
    assert read("lei № %n ~y?", "pela LEI n.º 4.321, de 1º de maio de 2001.") == ("LEI n.º 4.321, de 1º de maio de 2001", {"n": "4321", "y": "2001"})
    assert read("Lei № %n ~y?", "pela lei 9") is None and read("do Lei", "do lei") is None
    assert read("anexo &k? da", "do Anexo XIV da") == ("Anexo XIV da", {"k": "XIV"}) and read("anexo &k? da", "Anexo da") == ("Anexo da", {})
    assert read("%4321", "nº 4.321,5") == ("4.321", {}) and read("%4321", "44.321") is None
    assert read("@a - @b", "pós–guerra") == ("pós–guerra", {"a": "pós", "b": "guerra"})


def test_questions():
    assert references("O art. 9, § 2º, II, b) e o artigo 12-D?") == [Place("lgpd", None, "9", "2", "II", "b"), Place("lgpd", None, "12D")]
    assert references("Pela LAI, art 3º parágrafo único, inciso IV-B, alínea “c”") == [Place("lai", None, "3", "u", "IV-B", "c")]
    assert references("resolução CD/ANPD nº 8/2040, artigo 1") == [Place("res-anpd-8-2040", None, "1")]
    assert references("resolução 8, de 4 de julho de 2040: art. 1º, parágrafo 7") == [Place("res-anpd-8-2040", None, "1", "7")]
    assert references("a arte 5 e o art. sem número") == [] and references("art. 2º e art. 2") == [Place("lgpd", None, "2")]
    assert acts_outside("O  Código  Penal e o estatuto do torcedor, ou a GDPR e o código penal") == ["Código Penal", "estatuto do torcedor", "GDPR", "código penal"]
    assert acts_outside("A LGPD e a GDPR") == [] and acts_outside("a lei 13.709 e a CLT") == [] and acts_outside("nada") == []
