"""Numbered redaction (OP-D01, A16), Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions.text import valid_cnpj, valid_cpf

#: How the kinds are written, in the order in which they are taken, as digits of the first two are no phone
#: numbers. #: a digit; D: a digit but 0; X: a digit or a capital; _: a space or dash; [...]: may be left out.
WRITTEN = {"CNPJ": "XX[.]XXX[.]XXX[/]XXXX[-]##", "CPF": "###[.]###[.]###[-]##", "PHONE": "[[+]55[_]][(]D#[)][_][9]####[_]####"}
#: An address has bounded parts, so that it is found in linear time: the local part, a label, labels after the first.
LOCAL_MOST, LABEL_MOST, LABELS_MOST = 64, 63, 8
#: What may not stand before a value of each kind; none has a word character or a dash after it.
NOT_BEFORE = {"CNPJ": r"\w.", "CPF": r"\w.", "EMAIL": r"\w.+-", "PHONE": r"\w+"}


def as_pattern(written: str) -> str:
    signs = {"#": "[0-9]", "D": "[1-9]", "X": "[0-9A-Z]", "_": r"[\s-]", "[": "(?:", "]": ")?"}
    return "".join(signs.get(c) or (c if c.isalnum() else "\\" + c) for c in written)


def pattern_of(kind: str) -> str:
    label = f"[A-Za-z0-9-]{{1,{LABEL_MOST}}}"
    value = as_pattern(WRITTEN[kind]) if kind in WRITTEN else rf"[\w.+-]{{1,{LOCAL_MOST}}}@{label}(?:\.{label}){{1,{LABELS_MOST}}}"
    return rf"(?<![{NOT_BEFORE[kind]}]){value}(?![\w-])"


PATTERNS = {kind: pattern_of(kind) for kind in ("CNPJ", "CPF", "EMAIL", "PHONE")}
VALID = {"CNPJ": valid_cnpj, "CPF": valid_cpf}
NOTHING = "cast(named_struct('n', 0, 'parts', array()) as struct<n: int, parts: array<string>>)"


def numbered(text: Column, kind: str) -> Column:
    """struct<n, parts>: the found values numbered, as pieces to be joined."""
    pattern = "(?U)" + PATTERNS[kind]
    value = lambda m: F.upper(F.regexp_replace(m, "[^0-9A-Za-z]", ""))
    good = lambda m: VALID[kind](value(m)) if kind in VALID else F.lit(True)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def add(acc: Column, pair: Column) -> Column:
        hit = pair["match"].isNotNull() & F.coalesce(good(pair["match"]), F.lit(False))
        n = acc["n"] + F.when(hit, 1).otherwise(0)
        mark = F.when(hit, F.concat(F.lit(f"[{kind}_"), n.cast("string"), F.lit("]"))).otherwise(F.coalesce(pair["match"], F.lit("")))
        return F.struct(n.alias("n"), F.concat(acc["parts"], F.array(pair["between"], mark)).alias("parts"))

    return F.aggregate(pairs, F.expr(NOTHING), add)


def redact(df, column: str = "text"):
    """df with the column redacted, and n_cnpj, n_cpf, n_email, n_phone. Null stays null, with counts of 0."""
    for kind in PATTERNS:
        df = df.withColumn("_found", numbered(F.col(column), kind))
        df = df.withColumns({column: F.array_join("_found.parts", ""), f"n_{kind.lower()}": F.coalesce(F.col("_found.n"), F.lit(0)).cast("long")}).drop("_found")
    return df
