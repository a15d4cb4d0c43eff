"""Pages of acts: links, earlier wordings, headings."""

from datetime import date

from lexgrove.operators.reports import act_pages

KINDS = "id string, document_id string, label string, path array<string>, text string, revoked boolean, vetoed boolean, ordinal int"


def test_pages(spark):
    rows = [
        ("a:art1", "a", "Art. 1º", ["TÍTULO I", "Art. 1º"], "Vale <b> o art. 2º & o art. 3º.", False, False, 0),
        ("a:art1:incI", "a", "I", ["TÍTULO I", "Art. 1º", "I"], None, True, False, 1),
        ("a:art2", "a", "Art. 2º", ["TÍTULO II", "Mar", "Art. 2º"], "😀 fim", False, True, 2),
    ]
    links = [("a:art1", 11, 18, "a:art2"), ("a:art1", 13, 20, "a:art9"), ("a:art1", 23, 30, "a:art3"), ("a:art1", 40, 50, "a:art4"), ("a:art2", 2, 5, "a:art1")]
    versions = [("a:art1", 1, "Valia <x>.", None, None, date(2001, 2, 3)), ("a:art1", 2, "Vale", "Lei nº 5", date(2001, 2, 3), None), ("a:art2", 1, "só uma", None, None, None)]
    provisions = spark.createDataFrame(rows, KINDS)
    page = act_pages(
        provisions,
        spark.createDataFrame(links, "source string, start int, end int, target string"),
        spark.createDataFrame(versions, "id string, seq int, text string, introduced_by string, valid_from date, valid_to date"),
        headings=True,
    ).first()
    lines = page.html.split("\n")
    assert page.in_force == 1
    assert lines[0] == '<h2>TÍTULO I</h2><p id="a:art1"><b>Art. 1º</b> Vale &lt;b&gt; o <a href="#a:art2">art. 2º</a> &amp; o <a href="#a:art3">art. 3º</a>.</p><details><summary>Redações anteriores</summary><p>? – 03/02/2001: Valia &lt;x&gt;.</p></details>'
    assert lines[1] == '<p id="a:art1:incI"><b>I</b> <em>revogado</em> </p>'
    assert lines[2] == '<h2>TÍTULO II</h2><h2>Mar</h2><p id="a:art2"><b>Art. 2º</b> <em>vetado</em> 😀 <a href="#a:art1">fim</a></p>'
    plain = act_pages(provisions.where("text is not null")).first().html
    assert "<a" not in plain and "<h2>" not in plain and act_pages(provisions.limit(0)).count() == 0
