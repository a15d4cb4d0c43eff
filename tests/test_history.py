"""Histories from struck text, dates of acts, wordings on a day."""

from datetime import date

from lexgrove.operators.history import extract_history
from lexgrove.operators.temporal import ORIGINAL, UNAMENDED, dated, version_at, wording_on
from lexgrove.sources.acts import NO_CLAUSE, STAGGERED, WRONG_PAGE, act_links, dates, describe, merge_acts, read_page
from lexgrove.sources.html import html_blocks

MP, LAW = "Medida Provisória nº 869, de 2018", "Lei nº 13.853, de 2019"
PAGE = f"""<p>Art. 5º Considera-se:</p>
<p><span style="text-decoration:line-through">XIX - autoridade: órgão indireto.</span></p>
<p><strike>XIX - autoridade: órgão. <a href="m.htm">(Redação dada pela {MP})</a></strike></p>
<p>XIX - autoridade: entidade. <a href="l1.htm#art2">(Redação dada pela {LAW})</a></p>
<p>XX - novo conceito. <a href="l2.htm">(Incluído pela {LAW})</a></p>
<p><strike>Art. 55-A. Fica criada. (Incluído pela {MP})</strike></p>
<p><strike>I - primeiro órgão; (Incluído pela {MP})</strike></p>
<p><strike>Art. 55-A. Criada outra vez.</strike></p>
<p>CAPÍTULO IX</p>
<p>Art. 55-A. Fica criada a Autoridade. (Redação dada pela {LAW})</p>
<p>I - reformulado; (Redação dada pela {LAW}) (Promulgação partes vetadas)</p>
<p>Art. 56. Nunca mudou.</p>"""
ACT = "<p>LEI Nº 13.853, DE 8 DE JULHO DE 2019</p><p>\"Art. 65. Esta Lei entra em vigor:</p><p>I - dia 28\" (NR)</p><p>Art. 4º Esta Lei entra em vigor {}</p><p>Brasília, 8 de julho de 2019; 198º.</p><p>publicado no DOU de 9.7.2019</p>"


def versions(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    return extract_history(html_blocks(pages).selectExpr("'lgpd' as document_id", "line_no + 1 as line_no", "line", "struck"))


def test_struck_text_becomes_versions_and_gets_dates(spark):
    rows = versions(spark).orderBy("id", "seq").cache()
    got = {}
    for r in rows.collect():
        got.setdefault(r.id, []).append((r.text, r.introduced_by))
    assert got == {
        "lgpd:art5:incXIX": [("autoridade: órgão indireto.", None), ("autoridade: órgão.", MP), ("autoridade: entidade.", LAW)],
        "lgpd:art5:incXX": [("novo conceito.", LAW)],
        "lgpd:art55A": [("Fica criada.", MP), ("Criada outra vez.", None), ("Fica criada a Autoridade.", LAW)],
        "lgpd:art55A:incI": [("primeiro órgão;", MP), ("reformulado;", LAW)],
    }
    acts = spark.createDataFrame([(MP, date(2018, 12, 28)), (LAW, date(2019, 7, 9))], "name string, in_force_from date")
    known = dated(rows, acts)
    d = {(r.id, r.seq): (r.valid_from, r.valid_to, r.review) for r in known.collect()}
    assert d["lgpd:art5:incXIX", 1] == (None, date(2018, 12, 28), ORIGINAL) and d["lgpd:art5:incXIX", 2] == (date(2018, 12, 28), date(2019, 7, 9), None)
    assert d["lgpd:art55A:incI", 2][0] is None and "promulgated" in d["lgpd:art55A:incI", 2][2]
    no_act = {(r.id, r.seq): r.review for r in dated(rows, acts.where("name like 'Lei%'")).collect()}
    assert no_act["lgpd:art5:incXIX", 2] == f"no in-force date for {MP}"
    current = spark.createDataFrame([("lgpd:art5:incXIX", "autoridade: entidade."), ("lgpd:art5:incXX", "novo conceito."), ("lgpd:art56", "Nunca mudou.")], "id string, text string")
    on = lambda day: {r.id: (r.text, r.certain, r.review) for r in wording_on(current, known, day).collect()}
    assert on("2018-01-01") == {"lgpd:art5:incXIX": ("autoridade: órgão indireto.", False, ORIGINAL), "lgpd:art56": ("Nunca mudou.", False, UNAMENDED)}
    assert on("2019-01-01")["lgpd:art5:incXIX"] == ("autoridade: órgão.", True, None)
    assert on("2020-01-01")["lgpd:art5:incXX"] == ("novo conceito.", True, None)


def test_version_at_needs_dates(spark):
    rows = [("a", 1, None), ("a", 2, date(2001, 1, 1)), ("a", 3, None), ("a", 4, date(2003, 1, 1)), ("b", 1, None)]
    v = spark.createDataFrame(rows, "id string, seq long, valid_from date")
    on = lambda day: sorted(tuple(r) for r in version_at(v, day).collect())
    assert on("2000-01-01") == [("a", 1, False), ("b", 1, False)] and on("2002-01-01") == [("a", 2, False), ("b", 1, False)]
    assert on("2004-01-01") == [("a", 4, True), ("b", 1, False)] and version_at(v.limit(0), "2000-01-01").count() == 0


def test_dates_of_acts(spark):
    text = lambda clause: read_page(ACT.format(clause))[0]
    assert dates(text("na data de sua publicação")) == (date(2019, 7, 9), "Esta Lei entra em vigor na data de sua publicação", date(2019, 7, 9), None)
    assert dates(text("em 17 de março de 2026."))[2:] == (date(2026, 3, 17), None)
    assert dates(text("após decorridos:"))[2:] == (None, STAGGERED) and dates("LEI Nº 1")[3] == NO_CLAUSE
    rows = [(LAW, "u", date(2026, 1, 1), ACT.format("na data de sua publicação").encode()), ("Lei nº 15.452, de 2026", "u", None, ACT.encode()), (None, None, None, None)]
    acts = describe(spark.createDataFrame(rows, "name string, url string, retrieved_at date, content binary"))
    assert {r.name: (r.in_force_from, r.review) for r in acts.collect()} == {LAW: (date(2019, 7, 9), None), "Lei nº 15.452, de 2026": (None, WRONG_PAGE), None: (None, WRONG_PAGE)}
    merged = {r.name: r.url for r in merge_acts(acts.where("name is not null"), acts.where(f"name = '{LAW}'").selectExpr("name", "'new' as url", "retrieved_at", "sha256", "dou_date", "vigencia", "in_force_from", "review")).collect()}
    assert merged == {LAW: "new", "Lei nº 15.452, de 2026": "u"}


def test_links_to_acts(spark):
    pages = spark.createDataFrame([("https://x.org/a/b/c.htm", PAGE + '<a href="z.htm">(Revogado pela Lei nº 1)</a>')], "url string, html string")
    assert {r.name: r.url for r in act_links(pages).collect()} == {MP: "https://x.org/a/b/m.htm", LAW: "https://x.org/a/b/l1.htm"}
