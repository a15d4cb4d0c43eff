"""Queries of the provision operators bound to the test tables, and their SQL.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import search as S
from lexgrove.operators.temporal import ORIGINAL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (read) -> DataFrame under its name, with its SQL where that can express it."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, as one small file gives, dealt out to all of them; others as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


FOLD = "translate(lower(text), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿºª', 'aaaaaaceeeeiiiinooooouuuuyyoa')"
TOKENS = f"regexp_extract_all({FOLD}, '[a-z0-9]+')"
POSTED = f"""
t AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents),
p AS (SELECT id, len(t) AS len, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM t),
q AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) WHERE length(term) > 1),
m AS (SELECT q.qid, p.id, p.len, p.pos FROM p JOIN q USING (term)),
"""
TOP10 = "SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def token_stats(read):
    t = T.tokens(F.col("text"))
    return read("documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


def _lexical(flag: int, score: str):
    def f(read):
        posted = S.postings(dealt(read("documents")))
        return S.cover_density(read("benchmark"), posted, flag, 10).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))

    f.__name__ = "lexical_topk" if flag == 4 else f"lexical_flag{flag}"
    gaps = "g AS (SELECT qid, id, len, pos, lag(pos) OVER (PARTITION BY qid, id ORDER BY pos) AS before FROM m),"
    return query(f"WITH {POSTED} {gaps} s AS (SELECT qid, id, round({score}, 6) AS score FROM g GROUP BY qid, id) {TOP10}")(f)


_lexical(4, "CASE WHEN count(*) < 2 THEN 0.1::DOUBLE * count(*) ELSE 0.1::DOUBLE * count(*) * sum(1.0::DOUBLE / (pos - before) ORDER BY pos) / count(*) END")
_lexical(0, "0.1::DOUBLE * count(*)")
_lexical(1, "0.1::DOUBLE * count(*) / (1 + ln(any_value(len)::DOUBLE))")
_lexical(2, "0.1::DOUBLE * count(*) / any_value(len)")
_lexical(32, "0.1::DOUBLE * count(*) / (0.1::DOUBLE * count(*) + 1)")

BM25 = f"""
tf AS (SELECT id, len, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT DISTINCT id, len FROM tf)),
s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
      FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY qid, id)"""


@query(f"WITH {POSTED} {BM25} {TOP10}")
def bm25_topk(read):
    return S.bm25(read("benchmark"), S.postings(dealt(read("documents"))), 10).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


#: Lists of the approximate index, and how many of them a query looks into: the test vectors lie in no clusters, 32 lists find 0.90 of the best ten.
ANN_LISTS, ANN_PROBES = 64, 40

DENSE = "SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"


def _dense(read, n):
    e = read("embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return S.dense_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), n)


@query(f"WITH s AS ({DENSE}) {TOP10}")
def dense_topk(read):
    return _dense(read, 10).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def ann_topk(read):
    """As dense_topk, over the lists nearest to a query; tests/test_ann.py measures the recall."""
    e = dealt(read("embeddings"))
    vectors = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    centres = S.fit_lists(vectors, ANN_LISTS)
    return S.ann_topk(q, S.ann_index(vectors, centres), centres, 10, ANN_PROBES).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {POSTED} {BM25}, lex AS ({TOP10}),
v AS ({DENSE}), den AS (SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM v) WHERE rank <= 10),
f AS (SELECT qid, id, round(sum(w / (60 + rank)), 6) AS score, min(rank) AS best FROM (SELECT qid, id, rank, 0.5::DOUBLE AS w FROM lex UNION ALL SELECT qid, id, rank, 1.0 FROM den) GROUP BY qid, id)
SELECT qid, id, score, best, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best, id) AS rank FROM f""")
def hybrid_rrf(read):
    lexical = S.bm25(read("benchmark"), S.postings(dealt(read("documents"))), 10)
    fused = S.rrf([(lexical, 0.5), (_dense(read, 10), 1.0)])
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "best", "id")
    return fused.select("qid", "id", "score", F.col("best").cast("long").alias("best"), F.row_number().over(order).cast("long").alias("rank"))


TREE = """tree AS (SELECT 'r' || r_regionkey || ':n' || n_nationkey || ':c' || c_custkey || ':o' || o_orderkey AS id, o_orderkey, o_totalprice, o_orderstatus
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _tree(read):
    """Orders as leaves of region, nation, customer: prefix-coded ids as those of provisions."""
    o = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("r", "n_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey"), ("o", "o_orderkey"))]
    return o.select(F.concat_ws(":", *parts).alias("id"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query(f"""WITH RECURSIVE {TREE}, up AS (SELECT id FROM tree UNION SELECT regexp_replace(id, ':[^:]+$', '') FROM up WHERE contains(id, ':')) SELECT id FROM up""")
def ancestors_recursive(read):
    return _tree(read).select(F.explode(T.ancestors(F.col("id"))).alias("id")).distinct()


@query(f"""WITH {TREE}, e AS (SELECT id, regexp_replace(id, ':o[0-9]+$', '') AS cited, CASE WHEN o_orderkey % 2 = 0 THEN id ELSE 'r9:n9' END AS other FROM tree)
SELECT id, (cited = id OR starts_with(id, cited || ':')) AS up, (other = id OR starts_with(id, other || ':') OR starts_with(other, id || ':')) AS same FROM e""")
def id_covers(read):
    i = F.col("id")
    return _tree(read).select("id", T.covers(F.element_at(T.above(i), -1), i).alias("up"), T.covers(F.when(F.col("o_orderkey") % 2 == 0, i).otherwise(F.lit("r9:n9")), i).alias("same"))


@query("SELECT p_partkey, p_size::BIGINT AS value FROM part")
def roman_annex(read):
    return read("part").select("p_partkey", T.roman_value(T.roman(F.col("p_size"))).cast("long").alias("value"))


def _orders_as_provisions(read):
    """Orders as provisions of their customers' acts: revoked if open, vetoed if pending."""
    return read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderstatus") == "O").alias("revoked"), (F.col("o_orderstatus") == "P").alias("vetoed"))


@query("SELECT o_orderkey AS id, o_orderstatus NOT IN ('O', 'P') AS normative FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def point_lookup(read):
    from lexgrove.operators.retrieval import lookup

    ids = read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return lookup(_orders_as_provisions(read), ids).select("id", "normative")


@query("SELECT o_custkey AS document_id, count(*) AS provisions, count(*) FILTER (o_orderstatus NOT IN ('O', 'P')) AS in_force FROM orders GROUP BY 1")
def in_force(read):
    from lexgrove.operators.retrieval import in_force_counts

    return in_force_counts(_orders_as_provisions(read))


@query("""SELECT o.o_orderkey AS rid, coalesce(a.o_orderkey, b.o_orderkey) AS found, CASE WHEN a.o_orderkey IS NULL AND b.o_orderkey IS NULL THEN o.o_orderkey * 3 + 1 END AS missing
FROM orders o LEFT JOIN orders a ON a.o_orderkey = o.o_orderkey * 2 LEFT JOIN orders b ON b.o_orderkey = o.o_orderkey * 3 + 1""")
def coalesce_candidates(read):
    o = read("orders")
    c = o.select(F.col("o_orderkey").alias("rid"), F.array(F.col("o_orderkey") * 2, F.col("o_orderkey") * 3 + 1).alias("ids"))
    return S.first_existing(c, o.select(F.col("o_orderkey").alias("id")))


@query("""WITH n AS (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000 ELSE 0 END AS doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.text IS DISTINCT FROM n.text""")
def snapshot_diff(read):
    from lexgrove.operators.temporal import diff

    d = read("documents").select("doc_id", "text")
    new = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 1000000).otherwise(0)).alias("doc_id"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return diff(d, new, "doc_id", ["text"])


VERSIONS = "v AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderkey AS text, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS valid_from FROM orders)"


def _versions(read):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read("orders").select(F.col("o_custkey").alias("id"), F.row_number().over(order).cast("long").alias("seq"), F.col("o_orderkey").alias("text"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("valid_from"))


ACTED = f"""{VERSIONS}, w AS (SELECT id, seq, text, CASE WHEN seq > 1 THEN 'act ' || text % 30 END AS introduced_by, CASE WHEN text % 17 = 0 THEN 'late' END AS review FROM v),
a AS (SELECT 'act ' || n_nationkey AS name, DATE '1995-01-01' + (n_nationkey * 7)::INT AS in_force_from FROM nation),
d AS (SELECT id, seq, introduced_by, CASE WHEN introduced_by IS NOT NULL AND review IS NULL THEN in_force_from END AS valid_from,
  coalesce(review, CASE WHEN introduced_by IS NULL THEN '{ORIGINAL.replace(chr(39), chr(39) * 2)}' WHEN in_force_from IS NULL THEN 'no in-force date for ' || introduced_by END) AS review FROM w LEFT JOIN a ON name = introduced_by)"""


def _dated(read):
    """Orders as wordings, brought in by acts of which some have a date, through the operator."""
    from lexgrove.operators.temporal import dated

    by = F.when(F.col("seq") > 1, F.concat(F.lit("act "), (F.col("text") % 30).cast("string")))
    versions = _versions(read).select("id", "seq", "text", by.alias("introduced_by"), F.when(F.col("text") % 17 == 0, "late").alias("review"))
    acts = read("nation").select(F.concat(F.lit("act "), F.col("n_nationkey").cast("string")).alias("name"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("n_nationkey") * 7).cast("int")).alias("in_force_from"))
    return dated(versions, acts)


@query(f"WITH {ACTED} SELECT id, seq, valid_from::VARCHAR AS valid_from, lead(valid_from) OVER (PARTITION BY id ORDER BY seq)::VARCHAR AS valid_to FROM d")
def valid_to_lead(read):
    return _dated(read).select("id", "seq", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query(f"""WITH {VERSIONS}, d AS (SELECT id, max(seq) FILTER (valid_from <= DATE '1997-01-01') AS chosen, min(seq) AS first FROM v GROUP BY id),
n AS (SELECT v.id, min(seq) AS next FROM v JOIN d USING (id) WHERE seq > chosen AND valid_from IS NOT NULL GROUP BY v.id)
SELECT d.id, coalesce(chosen, first) AS seq, chosen IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = d.id AND v.valid_from IS NULL AND v.seq > chosen AND v.seq < coalesce(next, 1000000)) AS certain
FROM d LEFT JOIN n ON n.id = d.id""")
def asof_wording(read):
    from lexgrove.operators.temporal import version_at

    return version_at(_versions(read), "1997-01-01")


@query(f"WITH {ACTED} SELECT id, seq, introduced_by, review FROM d")
def versions_join_acts(read):
    return _dated(read).select("id", "seq", "introduced_by", "review")


@query("""WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM n WHERE event_type = 'error' GROUP BY user_id, run""")
def struck_islands(read):
    from lexgrove.operators.temporal import islands

    return islands(read("events"), "user_id", ["ts", "event_id"], "event_type", "event_id").where("kind = 'error'").drop("kind")


@query("""SELECT b.item_id, d.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN length(trim(b.text, ' .;:,')) < 10 THEN 'too_short' WHEN NOT contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) THEN 'not_found' END AS issue
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 30""")
def citation_check(read):
    from lexgrove.operators.grounding import check_citations

    cited = read("benchmark").select("item_id", (F.col("item_id") * 30).alias("doc_id"), F.col("text").alias("quote"))
    return check_citations(cited, read("documents").select("doc_id", "text"), "doc_id").select("item_id", "known_id", "issue").withColumnRenamed("known_id", "doc_id")


#: Assistants' turns as blocks; most cite themselves, in every other conversation the second turn of four cites one that isn't there.
TURNS = """b AS (SELECT conv_id, turn, text, len(regexp_extract_all(translate(lower(text), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿºªß', 'aaaaaaceeeeiiiinooooouuuuyyoas'), '[a-z0-9_]+')) AS words FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 'unknown' END AS issue FROM b WHERE turn % 4 < 3 AND length(trim(text)) >= 40)"""


@query(f"""WITH {TURNS}, e AS (SELECT b.conv_id, b.turn, words >= 6 AS says, count(*) FILTER (c.turn IS NOT NULL AND issue IS NULL) AS valid, count(issue) AS invalid FROM b LEFT JOIN c USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id AS answer, sum(invalid) = 0 AND count(*) FILTER (says AND valid = 0) = 0 AND sum(valid) > 0 AS grounded, sum(invalid)::BIGINT AS n_invalid, count(*) FILTER (says AND valid = 0) AS n_uncited,
(sum(invalid) > 0)::INT + (count(*) FILTER (says AND valid = 0) > 0)::INT + (sum(valid) = 0)::INT AS n_reasons FROM e GROUP BY 1""")
def judge_verdict(read):
    from lexgrove.operators.grounding import judge

    turns = read("conversations").where("role = 'assistant'")
    own = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    blocks = turns.select(F.col("conv_id").alias("answer"), F.col("turn").alias("block"), "text")
    target = F.when((F.col("turn") % 4 == 1) & (F.col("conv_id") % 2 == 0), -1).otherwise(own)
    cited = turns.where("turn % 4 < 3 and length(trim(text)) >= 40").select(F.col("conv_id").alias("answer"), F.col("turn").alias("block"), target.alias("id"), F.col("text").alias("quote"))
    out = judge(blocks, cited, turns.select(own.alias("id"), "text"), "id")
    return out.select("answer", "grounded", "n_invalid", F.size("uncited_blocks").cast("long").alias("n_uncited"), F.size("reasons").alias("n_reasons"))


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n_email, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS text FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def redact_email(read):
    d = read("documents").where(F.col("text").contains("@") & F.col("text").rlike(EMAIL))
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).cast("long").alias("n_email"), F.regexp_replace("text", EMAIL, "[EMAIL]").alias("text"))


CPF = "lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0')"


def _mod11(s: str, weights: list[int]) -> str:
    total = " + ".join(f"(ascii(substr({s}, {i}, 1)) - 48) * {w}" for i, w in enumerate(weights, 1))
    return f"CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END"


@query(f"""WITH a AS (SELECT c_custkey, {CPF} AS b FROM customer), x AS (SELECT *, b || ({_mod11('b', list(range(10, 1, -1)))}) AS c FROM a), y AS (SELECT *, c || ({_mod11('c', list(range(11, 1, -1)))}) AS good FROM x)
SELECT c_custkey, good AS cpf, NOT regexp_matches(good, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid, false AS shifted FROM y""")
def cpf_validate(read):
    base = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    good = T.cpf_of(base)
    wrong = F.concat(F.substring("cpf", 1, 10), ((F.substring("cpf", 11, 1).cast("int") + 1) % 10).cast("string"))
    return read("customer").select("c_custkey", good.alias("cpf")).select("c_custkey", "cpf", T.valid_cpf(F.col("cpf")).alias("valid"), T.valid_cpf(wrong).alias("shifted"))


@query("""WITH h AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT b.item_id, min(CASE WHEN doc_id % 3 = 0 THEN rank END) AS first FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY 1)
SELECT count(*) AS items, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM r""")
def recall_mrr(read):
    from lexgrove.operators.evals import passages_in

    b = read("benchmark")
    found = passages_in(b, dealt(read("documents"))).withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy("doc_id")))
    first = b.select("item_id").join(found.where("doc_id % 3 = 0").groupBy("item_id").agg(F.min("rank").alias("first")), "item_id", "left")
    return first.agg(F.count("*").alias("items"), F.round(F.avg(F.when(F.col("first") <= 1, 1.0).otherwise(0.0)), 6).alias("hit1"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("SELECT coalesce(event_type, 'all') AS split, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY GROUPING SETS ((event_type), ())")
def latency_percentiles(read):
    from lexgrove.operators.evals import percentiles_by

    return percentiles_by(read("events"), "event_type", "value")


@query("SELECT DISTINCT d.doc_id FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def anti_unknown(read):
    from lexgrove.sources.corpus import unknown

    return unknown(read("documents"), read("labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(read):
    from lexgrove.sources.corpus import repeated

    return repeated(read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unexpected' WHEN d.source = 'src1' THEN 'stale' WHEN d.doc_id % 10 = 3 THEN 'dimension' END AS problem
FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.source = 'src1' OR d.doc_id % 10 = 3""")
def set_equality(read):
    """Documents as vectors, labels as what is expected: what keeps the vectors from being used."""
    from lexgrove.sources.corpus import check_vectors

    sha = F.when(F.col("source") == "src1", "old").otherwise("new")
    v = F.array_repeat(F.lit(0.0), F.when(F.col("doc_id") % 10 == 3, 3).otherwise(4))
    vectors = read("documents").select(F.col("doc_id").alias("id"), sha.alias("corpus_sha256"), v.alias("v"))
    return check_vectors(vectors, read("labels").select(F.col("doc_id").alias("id")), "new", 4)


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM documents GROUP BY lang")
def distinct_models_listagg(read):
    from lexgrove.sources.corpus import listed

    return listed(read("documents"), "lang", "source")


@query(f"SELECT doc_id FROM (SELECT doc_id, {FOLD} AS x FROM documents) WHERE contains(x, 'tion') AND contains(x, 'er') AND contains(x, 'que') ORDER BY doc_id LIMIT 50")
def terms_and_search(read):
    from lexgrove.operators.retrieval import holding_all

    return holding_all(read("documents"), "text", ["TION", "er", "qüe"]).select("doc_id").orderBy("doc_id").limit(50)


@query("""WITH s AS (SELECT c_custkey AS qid, c_custkey % 9 AS explicit, c_custkey % 7 AS missing, c_custkey % 5 AS foreign_, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS best FROM customer)
SELECT qid, CASE WHEN explicit = 1 THEN NULL WHEN missing = 1 THEN 'nonexistent_provision' WHEN foreign_ = 1 THEN 'out_of_scope' WHEN best IS NULL OR best < 1000 THEN 'low_score' END AS refused FROM s""")
def refusal_cascade(read):
    k = F.col("c_custkey")
    one = lambda n: F.when(k % n == 1, 1).otherwise(0)
    s = read("customer").select(k.alias("qid"), one(9).alias("explicit"), one(7).alias("missing"), one(5).alias("foreign"), F.when(k % 4 > 0, F.col("c_acctbal")).alias("best"))
    return S.refusal(s, 1000.0).select("qid", "refused")


CNPJ = "lpad((s_suppkey * 104729 % 1000000000000)::VARCHAR, 12, '0')"


@query(f"""WITH a AS (SELECT s_suppkey, {CNPJ} AS b FROM supplier), x AS (SELECT *, b || ({_mod11('b', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])}) AS c FROM a), y AS (SELECT *, c || ({_mod11('c', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])}) AS good FROM x)
SELECT s_suppkey, good AS cnpj, NOT regexp_matches(good, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$') AS valid, false AS shifted FROM y""")
def cnpj_validate(read):
    weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    base = F.lpad((F.col("s_suppkey") * 104729 % 1000000000000).cast("string"), 12, "0")
    one = F.concat(base, T.check_digit(base, weights[1:]).cast("string"))
    good = F.concat(one, T.check_digit(one, weights).cast("string"))
    wrong = F.concat(F.substring("cnpj", 1, 13), ((F.substring("cnpj", 14, 1).cast("int") + 1) % 10).cast("string"))
    return read("supplier").select("s_suppkey", good.alias("cnpj")).select("s_suppkey", "cnpj", T.valid_cnpj(F.col("cnpj")).alias("valid"), T.valid_cnpj(wrong).alias("shifted"))


@query(f"""WITH {POSTED} {BM25}, a AS ({TOP10}),
o AS (SELECT q.qid, p.id, count(DISTINCT p.term) AS o FROM p JOIN q USING (term) GROUP BY ALL),
b AS (SELECT a.qid, a.id, a.rank AS r1, row_number() OVER (PARTITION BY a.qid ORDER BY o DESC, a.id) AS r2 FROM a JOIN o ON a.qid = o.qid AND a.id = o.id),
c AS (SELECT qid, id, r1, round(1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2), 6) AS score FROM b)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r1) AS rank FROM c""")
def rerank_blend(read):
    posted = S.postings(dealt(read("documents")))
    head = S.bm25(read("benchmark"), posted, 10)
    return S.blend(head, S.top(S.overlap(read("benchmark"), posted, head), 10)).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH s AS ({DENSE}) {TOP10}".replace("rank <= 10", "rank <= 3"))
def topk_nearest3(read):
    return _dense(read, 3).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


FOUND = """h AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
r AS (SELECT b.item_id, CASE WHEN b.item_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, min(CASE WHEN doc_id % 3 = 0 THEN rank END) AS first FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY ALL)"""


@query(f"""WITH {FOUND} SELECT coalesce(split, 'all') AS split, count(*) AS items, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1,
round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM r GROUP BY GROUPING SETS ((split), ())""")
def eval_grouping_sets(read):
    return _metrics(read, 3).select("split", "items", "hit1", "mrr")


def _metrics(read, step):
    """Documents that hold an item's passage, ranked by id; those whose id step divides are the expected ones."""
    from lexgrove.operators.evals import metrics_by_split, passages_in

    b = read("benchmark")
    split = F.when(F.col("item_id") % 3 == 0, "holdout").otherwise("dev").alias("split")
    found = passages_in(b, dealt(read("documents"))).withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy("doc_id")))
    return metrics_by_split(b.select("item_id", split), found.where(F.col("doc_id") % step == 0))


@query("""WITH h AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
e AS (SELECT item_id, min(rank) AS first, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS r5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS r10 FROM h WHERE doc_id % 2 = 0 GROUP BY 1),
r AS (SELECT CASE WHEN item_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, first, r1, r5, r10 FROM benchmark LEFT JOIN e USING (item_id))
SELECT coalesce(split, 'all') AS split, count(*) AS items, round(avg(r1), 6) AS recall1, round(avg(r5), 6) AS recall5, round(avg(r10), 6) AS recall10, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit1,
round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM r GROUP BY GROUPING SETS ((split), ())""")
def recall_at_k(read):
    return _metrics(read, 2)


@query("""WITH p AS (SELECT event_type AS config, round(avg(value) FILTER (user_id % 3 > 0), 6) AS dev, round(avg(value) FILTER (user_id % 3 = 0), 6) AS holdout FROM events GROUP BY 1)
SELECT config, dev, holdout, CASE WHEN abs(dev - holdout) > 3 THEN 'differs' ELSE 'alike' END AS verdict FROM p""")
def gate_pivot(read):
    from lexgrove.operators.evals import gate

    split = F.when(F.col("user_id") % 3 == 0, "holdout").otherwise("dev")
    return gate(read("events").select(F.col("event_type").alias("config"), split.alias("split"), "value"), 3.0)


@query("""WITH h AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
c AS (SELECT a.x AS a, b.x AS b, k.x AS k FROM (SELECT unnest(range(5)) AS x) a, (SELECT unnest(range(3)) AS x) b, (SELECT unnest(range(4)) AS x) k),
r AS (SELECT a, b, k, item_id, doc_id, row_number() OVER (PARTITION BY a, b, k, item_id ORDER BY a * (doc_id % 7) + b * (doc_id % 5) + k * (doc_id % 3) DESC, doc_id) AS rank FROM h, c),
f AS (SELECT a, b, k, item_id, coalesce(1.0::DOUBLE / min(CASE WHEN doc_id % 4 = 0 THEN rank END), 0) AS rr FROM r GROUP BY ALL),
m AS (SELECT a, b, k, round(avg(rr), 6) AS mrr FROM f GROUP BY ALL)
SELECT a, b, k, mrr FROM m ORDER BY mrr DESC, a, b, k LIMIT 1""")
def grid_search(read):
    """60 settings, a table of that size, scored in one job."""
    from lexgrove.operators.evals import best_setting, passages_in

    spark = read("benchmark").sparkSession
    grid = spark.createDataFrame([(a, b, k) for a in range(5) for b in range(3) for k in range(4)], "a long, b long, k long")
    d = F.col("doc_id")
    score = F.col("a") * (d % 7) + F.col("b") * (d % 5) + F.col("k") * (d % 3)
    return best_setting(passages_in(read("benchmark"), read("documents")), grid, ["a", "b", "k"], score, d % 4 == 0)


@query("""WITH h AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
i AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, item_id % 5 = 4 AS refuse, item_id % 7 IN (1, 4) AS refused FROM benchmark),
e AS (SELECT item_id, min(CASE WHEN NOT refused THEN rank END) AS first, avg(CASE WHEN NOT refused AND rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r1, avg(CASE WHEN NOT refused AND rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS r5, avg(CASE WHEN NOT refused AND rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS r10
      FROM h JOIN i USING (item_id) WHERE doc_id % 2 = 0 GROUP BY 1),
r AS (SELECT i.*, first, r1, r5, r10 FROM i LEFT JOIN e USING (item_id))
SELECT coalesce(split, 'all') AS split, count(*) FILTER (NOT refuse) AS answerable, count(*) FILTER (refuse) AS refuse,
round(avg(coalesce(r1, 0)) FILTER (NOT refuse), 4) AS recall1, round(avg(coalesce(r5, 0)) FILTER (NOT refuse), 4) AS recall5, round(avg(coalesce(r10, 0)) FILTER (NOT refuse), 4) AS recall10,
round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT refuse), 4) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0)) FILTER (NOT refuse), 4) AS mrr,
round(avg(refused::INT::DOUBLE) FILTER (refuse), 4) AS refusal_accuracy, round(avg(refused::INT::DOUBLE) FILTER (NOT refuse), 4) AS false_refusal_rate
FROM r GROUP BY GROUPING SETS ((split), ())""")
def retrieval_evaluation(read):
    """The benchmark's items as questions, a fifth of them to be refused; documents that hold an item, by id, as its ranking, those with an even id as expected."""
    from lexgrove.operators.evals import evaluation, passages_in

    b = read("benchmark")
    items = b.select("item_id", F.when(F.col("item_id") % 3 == 0, "holdout").otherwise("dev").alias("split"), (F.col("item_id") % 5 == 4).alias("must_refuse"))
    ranked = passages_in(b, dealt(read("documents"))).select("item_id", F.col("doc_id").alias("id"), F.row_number().over(W.partitionBy("item_id").orderBy("doc_id")).alias("rank"))
    refusals = b.select("item_id", F.when((F.col("item_id") % 7).isin(1, 4), "low_score").alias("refused"))
    return evaluation(items, ranked.where("id % 2 = 0").select("item_id", "id"), ranked, refusals)


@query("""WITH i AS (SELECT user_id % 9 = 0 AS refuse, event_type <> 'error' AS answered, CASE WHEN event_id % 5 > 0 THEN (event_id % 4) / 4.0::DOUBLE END AS recall, event_id % 100 AS tin, user_id % 10 AS tout, value FROM events)
SELECT count(*) FILTER (NOT refuse) AS answerable, round(avg(answered::INT::DOUBLE) FILTER (NOT refuse), 6) AS answered_rate, round(avg(CASE WHEN answered THEN coalesce(recall, 0) ELSE 0 END) FILTER (NOT refuse), 6) AS citation_recall,
count(*) FILTER (refuse) AS must_refuse, round(avg((NOT answered)::INT::DOUBLE) FILTER (refuse), 6) AS refusal_accuracy, sum(tin)::BIGINT AS input_tokens, sum(tout)::BIGINT AS output_tokens,
round(quantile_cont(value, 0.5), 6) AS latency_p50, list_sort(list(value))[floor(0.95 * (count(*) - 1))::BIGINT + 1] AS latency_p95 FROM i""")
def generation_evaluation(read):
    """Events as answers to a golden set."""
    from lexgrove.operators.evals import generation_metrics

    e = read("events")
    recall = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 4) / F.lit(4.0))
    items = e.select((F.col("user_id") % 9 == 0).alias("must_refuse"), (F.col("event_type") != "error").alias("answered"), recall.alias("recall"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("user_id") % 10).alias("output_tokens"), F.col("value").alias("latency"))
    return generation_metrics(items).withColumn("latency_p50", F.round("latency_p50", 6))


@query("""WITH RECURSIVE e AS (SELECT event_id AS id, (user_id % 4)::VARCHAR AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT id, client, n, true AS allowed, [us] AS recent FROM e WHERE n = 1
UNION ALL SELECT id, client, n, len(held) < 3, CASE WHEN len(held) < 3 THEN list_append(held, us) ELSE held END FROM (SELECT e.id, e.client, e.n, e.us, [x for x in a.recent if x > e.us - 3600000000] AS held FROM a JOIN e ON e.client = a.client AND e.n = a.n + 1))
SELECT id, client, allowed FROM a""")
def rate_limit(read):
    from lexgrove.streaming.admission import admitted

    return admitted(read("events").withColumn("client", F.col("user_id") % 4), "client", "ts", "event_id", 3600, 3)


@query()
def html_blocks(read):
    from lexgrove.sources import html

    return html.html_blocks(read("pages"))


@query()
def html_lines(read):
    from lexgrove.sources import html

    return html.html_lines(read("pages"))


@query()
def redact_counts(read):
    from lexgrove.functions.privacy import redact

    return redact(read("documents").select("doc_id", "text")).select("doc_id", "n_cnpj", "n_cpf", "n_email", "n_phone", F.sha2("text", 256).alias("redacted_sha256"))


@query()
def hashing_embed(read):
    from lexgrove.functions import embedding

    return read("documents").select("doc_id", F.array_join(embedding.hashing_embed(F.col("text"), 64), ",").alias("embedding"))


from lexgrove import act_queries  # noqa: E402, F401  (registers its queries)
