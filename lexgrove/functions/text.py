"""Text functions, Column -> Column (OP-C01, C04, C05, C06, D02, D03, I01-I07, R01)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and ordinals, and what they fold to.
ACCENTED = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿºª"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyoa"


def fold(c: Column) -> Column:
    """OP-C01: lower case without accents; ordinals become letters."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column) -> Column:
    """The analyzer of both sides of a search: runs of folded letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def or_terms(c: Column) -> Column:
    """OP-R01: a question's distinct terms of two or more characters."""
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 1))


def clip(c: Column, n: int) -> Column:
    """OP-C05: at most n characters, cut at the last space, with an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n - 1), " [^ ]*$", ""), F.lit("…")))


#: Quotation marks, dashes, degree sign and hard space, as the reference makes them alike.
ALIKE = str.maketrans("“”„‘’–—°\xa0", "\"\"\"''--º ")


def normalize_for_match(c: Column) -> Column:
    """OP-C04: NFC; quotation marks, dashes and spaces made alike; case stays. In Python, as SQL has no NFC."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFC", t).translate(ALIKE)).strip())

    return run(c)


def check_digit(digits: Column, weights: list[int]) -> Column:
    """Weighted sum modulo 11: 0 for remainders under 2, else 11 less the remainder."""
    values = F.transform(F.split(digits, ""), lambda d: F.ascii(d) - 48)
    pairs = F.zip_with(values, F.array(*map(F.lit, weights)), lambda a, b: F.coalesce(a * b, F.lit(0)))
    rest = F.aggregate(pairs, F.lit(0), lambda a, b: a + b) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def valid_cpf(c: Column) -> Column:
    """OP-D02: eleven digits, not all equal, both check digits right."""
    one = check_digit(F.substring(c, 1, 9), list(range(10, 1, -1)))
    two = check_digit(F.substring(c, 1, 10), list(range(11, 1, -1)))
    ends = F.concat(one.cast("string"), two.cast("string"))
    return c.rlike("^[0-9]{11}$") & ~c.rlike(r"^([0-9])\1{10}$") & (F.substring(c, 10, 2) == ends)


def cpf_of(base: Column) -> Column:
    """OP-D04: the eleven digits of nine and their check digits; made numbers for tests, never stored ones."""
    one = F.concat(base, check_digit(base, list(range(10, 1, -1))).cast("string"))
    return F.concat(one, check_digit(one, list(range(11, 1, -1))).cast("string"))


def synthetic_cpf(seed: Column) -> Column:
    """OP-D04: a valid CPF, as it is written, that a seed always gives; its first nine digits aren't all equal."""
    n = F.pmod(F.xxhash64(seed), F.lit(999_999_998)) + 1
    base = F.lpad(F.when(n % 111_111_111 == 0, n + 1).otherwise(n).cast("string"), 9, "0")
    return F.regexp_replace(cpf_of(base), "(...)(...)(...)(..)", "$1.$2.$3-$4")


def valid_cnpj(c: Column) -> Column:
    """OP-D03: twelve letters or digits and two check digits; a letter counts as its code less 48."""
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    one = check_digit(F.substring(c, 1, 12), first)
    two = check_digit(F.substring(c, 1, 13), [6, *first])
    ends = F.concat(one.cast("string"), two.cast("string"))
    return c.rlike("^[0-9A-Z]{12}[0-9]{2}$") & ~c.rlike(r"^([0-9])\1{13}$") & (F.substring(c, 13, 2) == ends)


def ancestors(c: Column) -> Column:
    """OP-I05: the ids above an id, outermost first; the separator is a colon."""
    parts = F.split(c, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))


def above(c: Column) -> Column:
    return F.slice(ancestors(c), F.lit(1), F.size(F.split(c, ":")) - 1)


def covers(a: Column, b: Column) -> Column:
    """OP-I07: either id is the other or contains it."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit(":"))) | F.startswith(b, F.concat(a, F.lit(":")))


def roman_value(c: Column) -> Column:
    """OP-I04: the number a roman numeral stands for."""
    worth = F.create_map(*[F.lit(x) for p in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in p])
    values = F.transform(F.split(F.upper(c), ""), lambda x: worth[x])
    after = F.concat(F.slice(values, 2, 100), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(values, after, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))


def roman(c: Column) -> Column:
    """A number under 100 as a roman numeral."""
    tens = F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]))
    ones = F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]))
    return F.concat(F.element_at(tens, F.floor(c / 10).cast("int") + 1), F.element_at(ones, (c % 10).cast("int") + 1))
