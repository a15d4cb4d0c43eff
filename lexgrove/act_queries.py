"""Queries over acts made by rule from the test tables, and their SQL.

A customer is an act, its orders are articles, the lines of an order are incisos: the parser, the
references and the cross-references must find again what the rule put there.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions import grammar as G
from lexgrove.functions import text as T
from lexgrove.operators import search as S
from lexgrove.queries import BM25, POSTED, TOP10, TREE, _tree, dealt, query

ROMANS = "[" + ", ".join(f"'{G.roman(n)}'" for n in range(1, 100)) + "]"
ACTS = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS art FROM orders),
i AS (SELECT o_custkey, art, l_quantity::BIGINT AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS inc FROM lineitem JOIN o ON l_orderkey = o_orderkey)"""


def _acts(read):
    """document_id, art, inc (0: the article itself), qty."""
    art = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read("orders").select("o_custkey", "o_orderkey", art.alias("art"))
    inc = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    i = read("lineitem").select("l_orderkey", inc.alias("inc"), F.col("l_quantity").cast("long").alias("qty")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    both = o.select("o_custkey", "art", F.lit(0).alias("inc"), F.lit(None).cast("long").alias("qty")).unionByName(i.select("o_custkey", "art", "inc", "qty"))
    return both.withColumn("document_id", F.concat(F.lit("act-"), F.col("o_custkey").cast("string")))


def _lines(read):
    mark = F.when(F.col("art") < 10, "º").otherwise(".")
    text = F.when(F.col("inc") == 0, F.format_string("Art. %d%s São itens:", "art", mark)).otherwise(F.format_string("%s - quantidade %d;", T.roman(F.col("inc")), "qty"))
    return _acts(read).select("document_id", (F.col("art") * 1000 + F.col("inc")).alias("line_no"), text.alias("line"))


@query(f"""WITH {ACTS}
SELECT 'act-' || o_custkey || ':art' || art AS id, NULL::VARCHAR AS parent_id, 'article' AS kind, 'São itens:' AS text, NULL::VARCHAR AS error FROM o
UNION ALL SELECT 'act-' || o_custkey || ':art' || art || ':inc' || {ROMANS}[inc], 'act-' || o_custkey || ':art' || art, 'inciso', 'quantidade ' || qty || ';', NULL FROM i""")
def provision_tree(read):
    from lexgrove.operators.structure import parse

    return parse(_lines(read)).select("id", "parent_id", "kind", "text", "error")


def _questions(read):
    k = F.col("o_orderkey")
    n = (k % 97 + 1).cast("int")
    text = (
        F.when(k % 4 == 0, F.format_string("O que diz o art. %dº, inciso %s, da LGPD?", n, T.roman(n)))
        .when(k % 4 == 1, F.format_string("Lei nº 12.527/2011, art. %d, § %dº", n, n))
        .when(k % 4 == 2, F.format_string("art. %d, parágrafo único, da Resolução CD/ANPD nº 15/2024", n))
        .otherwise(F.lit("Qual a pena de furto no Código Penal e no GDPR?"))
    )
    return read("orders").select(k, text.alias("question"))


@query(f"""WITH q AS (SELECT o_orderkey, (o_orderkey % 97 + 1)::VARCHAR AS n, {ROMANS}[o_orderkey % 97 + 1] AS r FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'lgpd:art' || n || ':inc' || r WHEN 1 THEN 'lai:art' || n || ':par' || n WHEN 2 THEN 'res-anpd-15-2024:anx1:art' || n || ':paru,res-anpd-15-2024:art' || n || ':paru' ELSE '' END AS candidates FROM q""")
def find_references(read):
    return _questions(read).select("o_orderkey", F.array_join(F.flatten(G.find_references(F.col("question"))), ",").alias("candidates"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'Código Penal,GDPR' ELSE '' END AS acts FROM orders")
def other_acts(read):
    return _questions(read).select("o_orderkey", F.array_join(G.other_acts(F.col("question")), ",").alias("acts"))


@query(f"""WITH {POSTED} {BM25}, a AS ({TOP10}),
u AS (SELECT b.item_id AS qid, d.doc_id AS id, 0 AS turn, 0 AS pos, 1.0::DOUBLE AS score FROM benchmark b JOIN documents d ON contains(d.text, b.text) UNION ALL SELECT qid, id, 1, rank, score FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY turn, pos) AS k FROM u),
o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY turn, pos, id) AS rank FROM f WHERE k = 1)
SELECT * FROM o WHERE rank <= 10""")
def explicit_first(read):
    from lexgrove.operators.evals import passages_in

    b, d = read("benchmark"), dealt(read("documents"))
    named = passages_in(b, d).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"))
    return S.explicit_first(named, S.bm25(b, S.postings(d), 10), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {TREE}, t AS (SELECT o_orderkey, id, regexp_replace(id, ':o[0-9]+$', '') AS above FROM tree),
e AS (SELECT o_orderkey AS qid, id FROM t UNION SELECT o_orderkey, above || ':o' || (o_orderkey + 1) FROM t),
c AS (SELECT o_orderkey AS qid, CASE o_orderkey % 3 WHEN 0 THEN above WHEN 1 THEN id || ':l1' ELSE 'r9' END AS id FROM t),
m AS (SELECT e.qid, e.id, coalesce(bool_or(c.id = e.id OR starts_with(e.id, c.id || ':') OR starts_with(c.id, e.id || ':')), false) AS met FROM e JOIN c USING (qid) GROUP BY ALL)
SELECT qid, count(*) AS expected, count(*) FILTER (met) AS met, round(count(*) FILTER (met) / count(*), 6) AS recall FROM m GROUP BY qid""")
def prefix_citation_recall(read):
    from lexgrove.operators.evals import citation_recall

    t = _tree(read).select(F.col("o_orderkey").alias("qid"), "id", F.element_at(T.above(F.col("id")), -1).alias("above"))
    expected = t.select("qid", F.explode(F.array("id", F.concat("above", F.lit(":o"), (F.col("qid") + 1).cast("string")))).alias("id"))
    cited = F.when(F.col("qid") % 3 == 0, F.col("above")).when(F.col("qid") % 3 == 1, F.concat("id", F.lit(":l1"))).otherwise(F.lit("r9"))
    return citation_recall(t.select("qid", cited.alias("id")), expected)


@query()
def length_batches(read):
    from lexgrove.operators.batches import token_batches

    return token_batches(read("documents"), "doc_id", "text")


#: Incisos that cite, each in one of six forms; the last three name nothing in the corpus.
@query(f"""WITH {ACTS}, s AS (SELECT 'act-' || o_custkey AS act, art, inc, {ROMANS}[inc] AS r, art % 5 + 1 AS a, {ROMANS}[inc % 4 + 1] AS b FROM i),
f AS (SELECT act, act || ':art' || art || ':inc' || r AS source, inc % 6 AS form, a, b, art FROM s),
k AS (SELECT source, 11 AS s, 11 + length('art. ' || a || ', inciso ' || b || ', desta Lei') AS e, act || ':art' || a || ':inc' || b AS target FROM f WHERE form = 0
UNION ALL SELECT source, 12, 12 + length('inciso ' || b || ' do caput deste artigo'), act || ':art' || art || ':inc' || b FROM f WHERE form = 1
UNION ALL SELECT source, 4, 4 + length('arts. ' || a), act || ':art' || a FROM f WHERE form = 2
UNION ALL SELECT source, 4 + length('arts. ' || a || ' e '), 4 + length('arts. ' || a || ' e ' || (a + 1) || ' desta Lei'), act || ':art' || (a + 1) FROM f WHERE form = 2),
known AS (SELECT source AS id FROM f UNION SELECT act || ':art' || art FROM f)
SELECT source, s::INT AS "start", e::INT AS "end", target FROM k WHERE source <> target AND target IN (SELECT id FROM known)""")
def xref_edges(read):
    from lexgrove.operators.crossrefs import edges

    every = _acts(read)
    a, b = F.col("art") % 5 + 1, T.roman(F.col("inc") % 4 + 1)
    forms = [
        F.format_string("Conforme o art. %d, inciso %s, desta Lei.", a, b),
        F.format_string("Na forma do inciso %s do caput deste artigo", b),
        F.format_string("Nos arts. %d e %d desta Lei", a, a + 1),
        F.format_string("Segundo o art. %d da LGPD", a),
        F.format_string("Pelo art. %d da Constituição", a),
        F.format_string("Passa a vigorar com a seguinte redação: “o art. %d desta Lei”", a),
    ]
    text = F.element_at(F.array(*forms), (F.col("inc") % 6 + 1).cast("int"))
    name = F.format_string("%s:art%d", "document_id", "art")
    articles = every.where("inc > 0").select(name.alias("id"), F.lit("").alias("text")).distinct()
    return edges(every.where("inc > 0").select(F.concat(name, F.lit(":inc"), T.roman(F.col("inc"))).alias("id"), text.alias("text")).unionByName(articles))


#: An order as an article with a chapter before every fourth, a rubric before every third, a paragraph of its own line or within
#: the article's, a continuation, a quoted amendment, a letter, an item, and an inciso that is revoked or vetoed.
CHAPTER = f"'CAPÍTULO ' || {ROMANS}[(art - 1) // 4 + 1] || ' — DO TEMA ' || (art - (art - 1) % 4)"
RUBRIC = "CASE WHEN art - art % 3 >= art - (art - 1) % 4 AND art >= 3 THEN 'Prazo ' || (art - art % 3) END"
FORMS = f"""o AS (SELECT 'act-' || o_custkey AS act, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS art FROM orders),
h AS (SELECT act, art, act || ':art' || art AS a, {CHAPTER} AS chapter, {RUBRIC} AS rubric, 'Art. ' || art || CASE WHEN art < 10 THEN 'º' ELSE '' END AS label, art % 5 = 0 AS sole FROM o),
g AS (SELECT *, concat_ws(' > ', chapter, rubric, label) AS path, a || CASE WHEN sole THEN ':paru' ELSE ':par1' END AS p, concat_ws(' > ', chapter, rubric, label, CASE WHEN sole THEN 'Parágrafo único' ELSE '§ 1º' END) AS ppath FROM h)"""


def _forms(read):
    from lexgrove.operators.structure import parse

    o = _acts(read).where("inc = 0").select("document_id", "art")
    a = F.col("art").cast("int")
    mark = F.when(a < 10, "º").otherwise(".")
    sole = a % 5 == 0
    lines = F.array(
        F.when(a % 4 == 1, F.concat(F.lit("CAPÍTULO "), T.roman(F.floor((a - 1) / 4).cast("int") + 1))),
        F.when(a % 4 == 1, F.format_string("DO TEMA %d", a)),
        F.when(a % 3 == 0, F.format_string("Prazo %d", a)),
        F.when(sole, F.format_string("Art. %d%s Vale o item %d. Parágrafo único. Só %d.", a, mark, a, a)).otherwise(F.format_string("Art. %d%s Vale o item %d. (Redação dada pela Lei nº %d, de 2001)", a, mark, a, a)),
        F.when(~sole, F.format_string("§ 1º Conta %d dias", a)),
        F.when(~sole, F.lit("e noites.")),
        F.when(~sole, F.lit("“§ 8º Citado” (NR)")),
        F.lit("I - primeiro:"),
        F.lit("a) letra;"),
        F.lit("1. ponto;"),
        F.when(a % 2 == 0, F.lit("II - (Revogado pela Lei nº 9)")).otherwise("II - (VETADO);"),
    )
    return parse(o.select("document_id", "art", F.posexplode(lines).alias("_p", "line")).select("document_id", (F.col("art") * 100 + F.col("_p")).alias("line_no"), "line"))


@query(f"""WITH {FORMS},
n AS (SELECT a AS id, NULL AS parent_id, 'article' AS kind, path, 'Vale o item ' || art || '.' AS text, CASE WHEN sole THEN '' ELSE '(Redação dada pela Lei nº ' || art || ', de 2001)' END AS notes, false AS revoked, false AS vetoed FROM g
UNION ALL SELECT p, a, 'paragraph', ppath, CASE WHEN sole THEN 'Só ' || art || '.' ELSE 'Conta ' || art || ' dias e noites. “§ 8º Citado” (NR)' END, '', false, false FROM g
UNION ALL SELECT p || ':incI', p, 'inciso', ppath || ' > I', 'primeiro:', '', false, false FROM g
UNION ALL SELECT p || ':incI:alia', p || ':incI', 'alinea', ppath || ' > I > a)', 'letra;', '', false, false FROM g
UNION ALL SELECT p || ':incI:alia:item1', p || ':incI:alia', 'item', ppath || ' > I > a) > 1.', 'ponto;', '', false, false FROM g
UNION ALL SELECT p || ':incII', p, 'inciso', ppath || ' > II', '', CASE WHEN art % 2 = 0 THEN '(Revogado pela Lei nº 9)' ELSE '' END, art % 2 = 0, art % 2 = 1 FROM g)
SELECT * FROM n""")
def provision_forms(read):
    return _forms(read).select("id", "parent_id", "kind", F.array_join("path", " > ").alias("path"), "text", F.array_join("amendments", "|").alias("notes"), "revoked", "vetoed")


@query(f"WITH {FORMS} SELECT a AS id, chapter AS heading FROM g")
def carry_forward_heading(read):
    return _forms(read).where("kind = 'article'").select("id", F.element_at("path", 1).alias("heading"))


@query(f"WITH {FORMS} SELECT a AS id, rubric FROM g WHERE rubric IS NOT NULL")
def lead_rubric(read):
    rubric = F.element_at("path", -2)
    return _forms(read).where("kind = 'article'").where(rubric.startswith("Prazo")).select("id", rubric.alias("rubric"))


@query(f"""WITH {FORMS}, n AS (SELECT a AS id, concat_ws(' > ', CASE WHEN art % 4 = 1 THEN chapter END, CASE WHEN art % 3 = 0 THEN rubric END) AS headings FROM g
UNION ALL SELECT p, '' FROM g UNION ALL SELECT p || unnest([':incI', ':incI:alia', ':incI:alia:item1', ':incII']), '' FROM g) SELECT * FROM n""")
def heading_prefix_lag(read):
    from lexgrove.operators.reports import headings_on_change

    return headings_on_change(_forms(read)).select("id", F.array_join("headings", " > ").alias("headings"))


IDS = f"""{ACTS}, n AS (SELECT 'act-' || o_custkey AS doc, art, {ROMANS}[inc] AS r, qty, 'act-' || o_custkey || ':art' || art || ':inc' || {ROMANS}[inc] AS id, inc FROM i)"""


@query(f"""WITH {IDS} SELECT id, doc, art::VARCHAR AS article, r AS inciso, id AS again FROM n UNION ALL SELECT id || ':', NULL, NULL, NULL, NULL FROM n WHERE inc = 1""")
def id_parse(read):
    own = _acts(read).where("inc > 0").select(F.format_string("%s:art%d:inc%s", "document_id", "art", T.roman(F.col("inc"))).alias("id"), "inc")
    both = own.select("id").unionByName(own.where("inc = 1").select(F.concat("id", F.lit(":")).alias("id"))).withColumn("p", G.parse_id(F.col("id")))
    return both.select("id", "p.doc", "p.article", "p.inciso", F.when(F.col("p").isNotNull(), G.format_id(F.col("p"))).alias("again"))


@query(f"""WITH {IDS}, f AS (SELECT art % 50 AS qid, id, doc || ':art' || art AS above, art, qty / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY art % 50 ORDER BY id) AS rank FROM n),
u AS (SELECT qid, id, score, rank AS o FROM f UNION ALL SELECT qid, above, score * 0.2::DOUBLE, 1000000 + rank * 10 + 1 FROM f WHERE art % 3 > 0),
t AS (SELECT qid, id, round(sum(score), 6) AS score, min(o) AS o FROM u GROUP BY ALL)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, o, id) AS rank FROM t""")
def ancestor_propagation(read):
    from lexgrove.operators.retrieval import propagate

    own = _acts(read).where("inc > 0").select((F.col("art") % 50).cast("long").alias("qid"), F.format_string("%s:art%d", "document_id", "art").alias("above"), "art", F.format_string("%s:art%d:inc%s", "document_id", "art", T.roman(F.col("inc"))).alias("id"), (F.col("qty") / F.lit(100.0)).alias("score"))
    fused = own.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("id")))
    return propagate(fused.select("qid", "id", "score", "rank"), own.where("art % 3 > 0").select(F.col("above").alias("id")), 0.2).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {IDS} SELECT id, CASE WHEN substr(doc, 5)::INT % 2 = 0 THEN 'Ato ' || substr(doc, 5) ELSE doc END || ' > Art. ' || art || ' > ' || r || chr(10) || 'São itens:' || chr(10) || 'quantidade ' || qty || ';' AS content FROM n WHERE qty % 7 > 0
UNION ALL SELECT DISTINCT doc || ':art' || art, CASE WHEN substr(doc, 5)::INT % 2 = 0 THEN 'Ato ' || substr(doc, 5) ELSE doc END || ' > Art. ' || art || chr(10) || 'São itens:' FROM n""")
def chunk_context(read):
    from lexgrove.operators.retrieval import chunks

    every = _acts(read)
    article, label = F.format_string("%s:art%d", "document_id", "art"), F.format_string("Art. %d", "art")
    i = every.where("inc > 0").select(F.concat(article, F.lit(":inc"), T.roman(F.col("inc"))).alias("id"), "document_id", F.array(label, T.roman(F.col("inc"))).alias("path"), F.format_string("quantidade %d;", "qty").alias("text"), (F.col("qty") % 7 == 0).alias("revoked"))
    a = every.where("inc > 0").select(article.alias("id"), "document_id", F.array(label).alias("path"), F.lit("São itens:").alias("text"), F.lit(False).alias("revoked")).distinct()
    names = every.where("inc = 0 and o_custkey % 2 = 0").select("document_id", F.concat(F.lit("Ato "), F.col("o_custkey").cast("string")).alias("short_name")).distinct()
    return chunks(i.unionByName(a).withColumn("vetoed", F.lit(False)), names)
