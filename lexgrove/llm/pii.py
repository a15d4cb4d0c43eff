"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans come from fixed patterns and checks and always stay. High-recall generators propose
further spans: spelled-out addresses, long IPs, phone numbers without a plus sign, card-like numbers
whose check digit fails. Boosted trees score them by format (digits, groups, separators, check digit)
and context (words before, neighbouring characters); a kind's calibrated threshold selects which are
added. The trees are fitted on spans made from templates by rule, since no table labels any, with the
same feature expressions; they are then a CASE expression, so that scoring stays in the JVM.

Positions are code points, ends exclusive: a pattern's matches and the pieces between them give them
by running lengths. Patterns are possessive, and start only where a longer match can't have begun, so
their time is linear in the text. Arrays of matches are gone through in parts of PART, whose running
totals are worked out first: k matches take PART * k + (k / PART)^2 steps, not k^2.

Nulls: a null text is empty and has no spans; a null doc_id is kept; repeated rows are each scanned;
an empty table gives an empty result. Spans of one kind never overlap; an added span never overlaps a
base span. Further columns are ignored by found() and kept by redacted().
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import id_text, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that Java takes them without recursion and without retries.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings of which a text must have one, or a short pattern, before the pattern itself is tried: most texts have none.
NEEDS = {"email": ["@"], "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": ["+"]}
#: Parts of addresses of which at least one separator is spelled.
LOCAL, LABEL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", "[A-Za-z0-9-]++"
AT = r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?"
DOT = r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?"
#: Generators of further candidates.
MORE = {
    "email": rf"{LOCAL}(?:{AT}{LABEL}(?:(?:{DOT}|\.){LABEL})++|\x20?@\x20?{LABEL}(?:\.{LABEL})*+{DOT}{LABEL}(?:(?:{DOT}|\.){LABEL})*+)",
    "ip": r"(?=[0-9A-Fa-f])(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}+(?![0-9A-Fa-f:])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,6}+)?+(?![0-9A-Za-z:])",
    "card": BASE["card"],
    "phone": r"(?=[0-9(])(?<![0-9A-Za-z+.(-])\(?[0-9]{2,5}+\)?(?:[\x20.()-]{1,2}+[0-9]{2,4}+){2,4}+(?![0-9A-Za-z])",
}
MORE_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]|\x20at\x20|[(\[{]dot[)\]}]|\x20dot\x20", "ip": [":"], "phone": "[0-9]"}
CONTEXT = 24
#: Elements of a part of an array, and characters of a part of a text.
PART, STRETCH = 128, 4096
#: Share of right spans above a kind's threshold, on templates the trees haven't seen.
PRECISION = 0.97
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|master|credit|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobil|dial",
    "other": "version|section|date|isbn|order|page|build|serial|id",
}
FEATURES = ("kind", "digits", "length", "groups", "longest", "check", "paren", "double_zero", "word", "other", "before", "date_like", "letters")


def emptied(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def pieces(text: Column, pattern: str, needs: str | list[str]) -> Column:
    """array<struct<between, match>>: a pattern's matches, each with the text before it. Keep it in a column: spans() reads it often."""
    between = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(between.alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")), lambda x: x["match"].isNotNull())
    gate = text.rlike(needs) if isinstance(needs, str) else functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in needs])
    return F.when(gate & text.rlike(pattern), pairs).otherwise(emptied("struct<between: string, match: string>"))


def in_parts(items: Column, total, combined, start, step, kind: str) -> Column:
    """The arrays that step adds up, over all items in order, one after another.

    total(item): a number; combined(a, b): joins totals, which begin with 0; start(k, before): the
    accumulator of the part after k items with the total `before`, a struct with the array `all`.
    """
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    part = lambda k: F.slice(items, k * PART + 1, PART)
    sums = F.transform(parts, lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: combined(a, total(x))))
    running = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(combined(F.element_at(a, -1), n))))
    each = F.transform(F.arrays_zip(parts.alias("k"), running.alias("before")), lambda p: F.aggregate(part(p["k"]), start(p["k"] * PART, p["before"]), step, lambda acc: acc["all"]))
    # The last running total has no part.
    return F.when(F.size(items) > 0, F.flatten(F.filter(each, lambda x: x.isNotNull()))).otherwise(emptied(kind))


SPAN = "struct<start: int, end: int, match: string, left: string>"


def spans(pairs: Column) -> Column:
    """array<struct<start, end, match, left>> of what pieces() gives; left is the CONTEXT characters before it."""
    joined = lambda x: F.concat(x["between"], x["match"])
    tail = lambda c: F.substring(c, -CONTEXT, CONTEXT)

    def start(k: Column, before: Column) -> Column:
        # No match is empty, so as many pieces as CONTEXT has characters hold the context.
        left = F.when(k > 0, tail(F.array_join(F.transform(F.slice(pairs, F.greatest(k - CONTEXT + 1, F.lit(1)), CONTEXT), joined), ""))).otherwise("")
        return F.struct(before.alias("at"), left.alias("left"), emptied(SPAN).alias("all"))

    def add(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["between"])
        end = begin + F.length(pair["match"])
        left = tail(F.concat(acc["left"], pair["between"]))
        item = F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match"), left.alias("left"))
        return F.struct(end.alias("at"), tail(F.concat(left, pair["match"])).alias("left"), F.concat(acc["all"], F.array(item)).alias("all"))

    return in_parts(pairs, lambda x: F.length(x["between"]) + F.length(x["match"]), lambda a, b: a + b, start, add, SPAN)


def stretches(spans_: Column) -> Column:
    """Parts of an array of spans in order of their starts, each with its least start and largest end."""
    parts = F.sequence(F.lit(0), F.floor((F.size(spans_) - 1) / PART).cast("int"))
    each = F.transform(parts, lambda k: F.slice(spans_, k * PART + 1, PART))
    each = F.transform(each, lambda x: F.struct(x[0]["start"].alias("low"), F.array_max(F.transform(x, lambda s: s["end"])).alias("high"), x.alias("spans")))
    return F.when(F.size(spans_) > 0, each).otherwise(emptied("struct<low: int, high: int, spans: array<struct<start: int, rank: int, end: int>>>"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    d = digits(s)
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return (F.aggregate(F.transform(each, lambda v: F.when(v > 9, v - 9).otherwise(v)), F.lit(0), lambda a, b: a + b) % 10) == 0


def part_fits(p: Column) -> Column:
    p = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(999)) <= 255)


def accepted(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(match, r"\."), part_fits),
        "card": n.between(12, 19) & luhn(match),
        "phone": n.between(9, 15),
    }[kind]


def features(kind: str, match: Column, left: Column) -> Column:
    """Of a candidate and what stands before it."""
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    left_words = F.lower(left)
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.length(digits(match)).alias("digits"),
        F.length(match).alias("length"),
        F.size(groups).alias("groups"),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).alias("longest"),
        (flag(luhn(match)) if kind == "card" else F.lit(0)).alias("check"),
        flag(match.rlike(r"^\(?[0-9]*\)") | match.rlike(r"^\(")).alias("paren"),
        flag(match.startswith("00")).alias("double_zero"),
        flag(left_words.rlike(rf"\b(?:{WORDS[kind]})[a-z]*\b[^.]*$")).alias("word"),
        flag(left_words.rlike(rf"\b(?:{WORDS['other']})s?\b[^.]*$")).alias("other"),
        flag(left.rlike(r"[\w.#$/-]$")).alias("before"),
        flag(match.rlike(r"^[0-9]{1,4}[. -][0-9]{1,2}[. -][0-9]{1,4}$")).alias("date_like"),
        F.length(F.regexp_replace(match, "[^A-Za-z]", "")).alias("letters"),
    )


#: A tree of depth two: (feature, cut, (feature, cut, low, high), (feature, cut, low, high)); low is for values up to the cut.
Tree = tuple


def fit_trees(x: list[tuple[int, ...]], y: list[int], rounds: int = 30, rate: float = 0.4) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting: Newton leaves, greedy cuts."""
    share = (sum(y) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    margin, trees = [base] * len(y), []
    columns = list(zip(*x))

    def best(rows: list[int], g: list[float], h: list[float]) -> tuple:
        out = None
        all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        for f, column in enumerate(columns):
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(column[i], [0.0, 0.0])
                s[0] += g[i]
                s[1] += h[i]
            low_g = low_h = 0.0
            for value in sorted(sums):
                low_g, low_h = low_g + sums[value][0], low_h + sums[value][1]
                gain = low_g**2 / (low_h + 1) + (all_g - low_g) ** 2 / (all_h - low_h + 1)
                if out is None or gain > out[0] + 1e-12:
                    out = (gain, f, value, rate * low_g / (low_h + 1), rate * (all_g - low_g) / (all_h - low_h + 1))
        return out[1:]

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        f, cut, *_ = best(list(range(len(y))), g, h)
        sides = [[i for i in range(len(y)) if (x[i][f] > cut) == k] for k in (False, True)]
        tree = (f, cut, *(best(s, g, h) if s else (0, 0, 0.0, 0.0) for s in sides))
        trees.append(tree)
        for i in range(len(y)):
            margin[i] += tree_value(tree, x[i])
    return base, trees


def tree_value(tree: Tree, x: tuple) -> float:
    f, cut, low, high = tree
    f, cut, a, b = high if x[f] > cut else low
    return b if x[f] > cut else a


def margin_column(base: float, trees: list[Tree], x: Column) -> Column:
    at = lambda f: x[FEATURES[f]]
    leaf = lambda t: F.when(at(t[0]) > t[1], F.lit(t[3])).otherwise(F.lit(t[2]))
    out = F.lit(base)
    for f, cut, low, high in trees:
        out = out + F.when(at(f) > cut, leaf(high)).otherwise(leaf(low))
    return out


def templates(n: int = 160, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(kind, words before, candidate, personal or not), made by rule."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdeilmnorst") for _ in range(r.randint(3, 8)))
    h = lambda: "".join(r.choice("0123456789abcdef") for _ in range(4))
    plain = ["the value of ", "see ", "", "was then "]
    hint = {"email": "mail: ", "ip": "server ip ", "card": "credit card ", "phone": "call "}
    other = ["version ", "order id ", "section ", "date ", "serial ", "isbn ", "build "]
    out = []
    for _ in range(n):
        at, dot = r.choice([("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]")])
        out.append(("email", r.choice([*plain, hint["email"]]), f"{w()}.{w()}{at}{w()}{dot}com", 1))
        out.append(("email", r.choice(plain), f"{w()} at {w()} dot {w()}", 0 if r.random() < 0.3 else 1))
        out.append(("ip", r.choice([*plain, hint["ip"]]), ":".join(h() for _ in range(8)), 1))
        out.append(("card", r.choice(["credit card ", "visa card no ", "my card: "]), r.choice([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}"]), 1))
        out.append(("card", r.choice([*plain, *other, *other]), r.choice([d(16), d(13), d(12), f"{d(4)}-{d(4)}-{d(4)}", f"{d(2)} {d(5)} {d(5)}"]), 0))
        out.append(("phone", r.choice([*plain, "call ", "tel ", "phone: "]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(4)} {d(2)}"]), 1))
        out.append(("phone", r.choice(["call ", "tel. no ", "phone: ", "fax "]), r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)}-{d(3)}-{d(3)}"]), 1))
        out.append(("phone", r.choice([*plain, *other]), r.choice([f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}-{d(4)}-{d(4)}"]), 0))
    return out


def fitted(spark: SparkSession) -> tuple[float, list[Tree], dict[str, float]]:
    """Base margin, trees, and each kind's threshold: the least margin that is right often enough on the other half of the templates."""
    rows = templates()
    made = None
    for kind in KINDS:
        part = spark.createDataFrame([(i, a, b) for i, (k, a, b, _) in enumerate(rows) if k == kind], "i int, before string, candidate string")
        part = part.select("i", features(kind, F.col("candidate"), F.col("before")).alias("x"))
        made = part if made is None else made.union(part)
    found = sorted((r.i, tuple(r.x)) for r in made.collect())
    x, y = [v for _, v in found], [rows[i][3] for i, _ in found]
    base, trees = fit_trees(x[::2], y[::2])
    margins = [base + sum(tree_value(t, v) for t in trees) for v in x]
    cuts = {}
    for k, kind in enumerate(KINDS):
        held = sorted(((m, label) for m, v, label in zip(margins[1::2], x[1::2], y[1::2]) if v[0] == k), reverse=True)
        right, cuts[kind] = 0, math.inf
        for i, (m, label) in enumerate(held, 1):
            right += label
            if right >= PRECISION * i and m > 0 and (i == len(held) or held[i][0] < m):
                cuts[kind] = m
    return base, trees, cuts


@functools.cache
def _model(key: str) -> tuple:
    return fitted(SparkSession.active())


def found(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """doc_id, text, base and all: arrays of struct<start, rank, end>, rank being a kind's place in KINDS."""
    return with_spans(id_text(docs), model).select("doc_id", "text", "base", "all")


def with_spans(docs: DataFrame, model: tuple | None = None) -> DataFrame:
    """docs, whose text isn't null, with the columns base and all."""
    base, trees, cuts = model or _model(docs.sparkSession.sparkContext.applicationId)
    own, text = docs.columns, F.col("text")
    docs = docs.withColumns({f"_pb_{k}": pieces(text, BASE[k], NEEDS[k]) for k in KINDS} | {f"_pm_{k}": pieces(text, MORE[k], MORE_NEEDS[k]) for k in KINDS if k != "card"})
    docs = docs.withColumns({f"_{c}": spans(F.col(f"_p{c}")) for c in [*(f"b_{k}" for k in KINDS), *(f"m_{k}" for k in KINDS if k != "card")]})
    docs = docs.withColumn("_m_card", F.filter("_b_card", lambda s: ~accepted("card", s["match"])))
    for k in KINDS:
        docs = docs.withColumn(f"_b_{k}", F.filter(f"_b_{k}", lambda s: accepted(k, s["match"])))
    placed = lambda k, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end")))
    docs = docs.withColumn("base", F.array_sort(F.concat(*[placed(k, F.col(f"_b_{k}")) for k in KINDS])))
    docs = docs.withColumn("_near", stretches(F.col("base")))
    more = []
    for k in KINDS:
        meets = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])
        free = lambda s: ~F.exists("_near", lambda p: (p["low"] < s["end"]) & (s["start"] < p["high"]) & F.exists(p["spans"], lambda b: meets(b, s)))
        scored = F.filter(F.col(f"_m_{k}"), lambda s: free(s) & (margin_column(base, trees, features(k, s["match"], s["left"])) >= cuts[k]))
        more.append(placed(k, F.when(F.size(f"_m_{k}") > 0, scored).otherwise(F.col(f"_m_{k}"))))
    docs = docs.withColumn("added", F.concat(*more))
    return docs.select(*own, "base", F.array_sort(F.concat("base", "added")).alias("all"))


def listed(c: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def cutout(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text that is given in parts of STRETCH characters."""
    i, j = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    across = F.concat(F.substring(part(i), a % STRETCH + 1, F.lit(STRETCH)), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(part(j), F.lit(1), b % STRETCH))
    return F.when(a >= b, "").when(i == j, F.substring(part(i), a % STRETCH + 1, b - a)).otherwise(across)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans give one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.col("_parts")

    def step(acc: Column, s: Column) -> Column:
        added = F.concat(acc["all"], F.array(cutout(parts, acc["at"], s["start"]), F.element_at(names, s["rank"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["all"]).otherwise(added).alias("all"))

    start = lambda _, before: F.struct(before.alias("at"), emptied("string").alias("all"))
    slim = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = with_spans(slim).withColumn("_parts", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))
    out = in_parts(F.col("all"), lambda s: s["end"], F.greatest, start, step, "string")
    end = F.coalesce(F.array_max(F.transform("all", lambda s: s["end"])), F.lit(0))
    new = F.concat(F.array_join(out, ""), cutout(parts, end, F.length("text")))
    new = F.when(F.col("_row.text").isNotNull(), F.when(F.size("all") > 0, new).otherwise(F.col("text"))).alias("text")
    return cut.select(*[new if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
