"""Canonical identifiers of provisions, and references in questions (OP-I01 to I04, R18 to R20)."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrove.functions.phrases import Phrase, Token, at, folded, ordinal, roman, roman_number, table, tokens

__all__ = ["ID", "LAWS", "PREFIXES", "SEGMENTS", "Place", "find_references", "folded", "format_id", "other_acts", "parse_id", "place", "references", "resolution_id", "roman", "roman_number"]

#: Fixed values.
ID = r"^(?<doc>[a-z0-9]+(?:-[a-z0-9]+)*)(?::anx(?<annex>[1-9][0-9]*))?:art(?<article>[0-9]+[A-Z]*)(?::par(?<paragraph>[0-9]+|u))?(?::inc(?<inciso>[IVXLCDM]+(?:-[A-Z])?))?(?::ali(?<alinea>[a-z]))?(?::item(?<item>[0-9]+))?$"
SEGMENTS = ["doc", "annex", "article", "paragraph", "inciso", "alinea", "item"]
PREFIXES = ["", "anx", "art", "par", "inc", "ali", "item"]
DEFAULT_ACT = "lgpd"
LAWS = {"13709": "lgpd", "12527": "lai"}
#: Acts outside the corpus, and how the corpus' own are named.
FOREIGN_ACTS = """
gdpr
rgpd
uk gdpr
ccpa
cpra
hipaa
pipeda
pipl
coppa
ferpa
regulamento geral sobre a protecao de dados
regulamento geral de protecao de dados
codigo penal
codigo civil
codigo de processo penal|civil
codigo tributario
codigo de transito
codigo de defesa do consumidor
codigo eleitoral
clt
consolidacao das leis do trabalho
constituicao federal?
marco civil da internet
lei maria da penha
estatuto do|da @whom
"""
OWN_ACTS = """
lgpd
lei geral de protecao de dados
%13709
lai
lei de acesso a informacao
%12527
anpd
"""
RESOLUTION = table([("slash", "resolucao cd? /? anpd? №? #number / #year"), ("date", "resolucao cd? /? anpd? №? #number ~year")])
ACCESS_LAW = table([("name", "lei de acesso a informacao"), ("number", "lei №? %12527")])
FOREIGN = [Phrase(line) for line in FOREIGN_ACTS.split("\n") if line]
OWN = [Phrase(line) for line in OWN_ACTS.split("\n") if line]

PARSED = "struct<" + ", ".join(f"{s}: string" for s in SEGMENTS) + ">"


class Place(NamedTuple):
    """A provision's identifier in parts."""

    doc: str | None = None
    annex: str | None = None
    article: str | None = None
    paragraph: str | None = None
    inciso: str | None = None
    alinea: str | None = None
    item: str | None = None

    def id(self) -> str:
        return ":".join(p + v for p, v in zip(PREFIXES, self) if v is not None)


PYTHON_ID = re.compile(ID.replace("(?<", "(?P<"))


def place(identifier: str) -> Place | None:
    m = PYTHON_ID.match(identifier)
    return m and Place(**m.groupdict())


def parse_id(c: Column) -> Column:
    """OP-I01: an identifier's parts; null when it isn't well formed."""
    part = lambda n: F.nullif(F.regexp_extract(c, ID, n), F.lit(""))
    return F.when(c.rlike(ID), F.struct(*[part(i).alias(s) for i, s in enumerate(SEGMENTS, 1)]))


def format_id(p: Column) -> Column:
    """OP-I02: the identifier of its parts."""
    return F.concat_ws(":", *[F.concat(F.lit(x), p[s]) for x, s in zip(PREFIXES, SEGMENTS)])


def resolution_id(number: str, year: str) -> str:
    return f"res-anpd-{int(number)}-{year}"


def act_of(toks: tuple[Token, ...]) -> str:
    """The act a question is about: a resolution it numbers, the access law, or the default."""
    for i in range(len(toks)):
        for _, phrase in RESOLUTION:
            if (found := phrase.match(toks, i)) and len(found.values["year"]) == 4:
                return resolution_id(found.values["number"], found.values["year"])
    named = any(t.text == "LAI" for t in toks) or any(True for _, phrase in ACCESS_LAW for _ in phrase.search(toks))
    return LAWS["12527"] if named else DEFAULT_ACT


#: How a note, or the label of its link, names the act that brought a wording.
BRINGS = [Phrase(p) for p in ("( redacao dada pelo|pela", "( incluido|incluida|acrescido|acrescida pelo|pela")]


def amending_act(note: str, closed: bool = True) -> str | None:
    """The act that the first note of a wording or an addition names, up to the next parenthesis; closed: that one must close the note."""
    toks = tokens(note)
    for found in sorted(f for phrase in BRINGS for f in phrase.search(toks)):
        act, sign, rest = (note[toks[found.after - 1].end :] + ("" if closed else ")")).partition(")")
        if sign and "(" not in act and act.strip() and (closed or not rest.strip(" )")):
            return " ".join(act.split())
    return None


def capital(t: Token | None) -> bool:
    return t is not None and t.kind == "word" and len(t.text) == 1 and t.text.isupper()


def lone_letter(t: Token | None) -> bool:
    return t is not None and t.kind == "word" and t.text in "abcdefghijklmnopqrstuvwxyz" and len(t.text) == 1


def numeral(toks: tuple[Token, ...], i: int) -> tuple[str, int] | None:
    """A Roman numeral at i, with a letter that a dash ties to it, and the token after it."""
    t = at(toks, i)
    if t is None or t.kind != "word" or not roman_number(t.text):
        return None
    dash, letter = at(toks, i + 1), at(toks, i + 2)
    tied = dash and dash.text == "-" and dash.glued and capital(letter) and letter.glued
    return (f"{t.text}-{letter.text}", i + 3) if tied else (t.text, i + 1)


class Question:
    """Reads what follows the word article, level by level; each level moves on only if it is there."""

    def __init__(self, toks: tuple[Token, ...], i: int, doc: str) -> None:
        self.toks, self.i, self.found = toks, i, Place(doc)

    def value(self, k: int = 0) -> str | None:
        t = at(self.toks, self.i + k)
        return t and t.value

    def past_comma(self) -> int:
        return self.i + (self.value() == ",")

    def article(self) -> bool:
        self.i += 1 + (self.value(1) == ".")
        t = at(self.toks, self.i)
        if t is None or t.kind != "number":
            return False
        number, self.i = str(int(t.text)), ordinal(self.toks, self.i)
        # The mark's own full stop is taken along; a dash and a capital make the article another one.
        if self.value() == "-" and capital(at(self.toks, self.i + 1)):
            number, self.i = number + self.toks[self.i + 1].text, self.i + 2
        self.found = self.found._replace(article=number)
        return True

    def paragraph(self) -> None:
        i = self.past_comma()
        word, after = at(self.toks, i), at(self.toks, i + 1)
        if word is None or after is None or word.value not in ("§", "paragrafo"):
            return
        if after.kind == "number":
            self.found, self.i = self.found._replace(paragraph=str(int(after.text))), ordinal(self.toks, i + 1)
        elif word.value == "paragrafo" and after.value == "unico":
            self.found, self.i = self.found._replace(paragraph="u"), i + 2

    def inciso(self) -> None:
        i = self.past_comma()
        t = at(self.toks, i)
        if got := numeral(self.toks, i + bool(t and t.value == "inciso")):
            self.found, self.i = self.found._replace(inciso=got[0]), got[1]

    def alinea(self) -> None:
        i = self.past_comma()
        named = bool((t := at(self.toks, i)) and t.value == "alinea")
        i += named
        opened = bool((t := at(self.toks, i)) and t.value == '"')
        letter, after = at(self.toks, i + opened), at(self.toks, i + opened + 1)
        closed = after is not None and after.glued and after.value == ('"' if opened else ")")
        if lone_letter(letter) and (named or closed):
            self.found = self.found._replace(alinea=letter.text)


def references(question: str) -> list[Place]:
    """OP-R18: the provisions a question names, in order, each once."""
    toks = tokens(question)
    doc, out = act_of(toks), {}
    for i, t in enumerate(toks):
        if t.value in ("art", "artigo"):
            reader = Question(toks, i, doc)
            if reader.article():
                reader.paragraph()
                reader.inciso()
                reader.alinea()
                out[reader.found] = None
    return list(out)


def find_references(c: Column) -> Column:
    """OP-R18, R19: array of each reference's candidate ids, likeliest first; a resolution's annex comes before itself."""

    @F.pandas_udf("array<array<string>>")
    def run(questions: pd.Series) -> pd.Series:
        def each(q: str | None) -> list[list[str]]:
            return [[p._replace(annex="1").id(), p.id()] if p.doc.startswith("res-") else [p.id()] for p in references(q or "")]

        return questions.map(each)

    return run(c)


def acts_outside(question: str) -> list[str]:
    """Acts outside the corpus, as they are written, unless the question names one inside."""
    toks, out, i = tokens(question), {}, 0
    if any(True for phrase in OWN for _ in phrase.search(toks)):
        return []
    while i < len(toks):
        after = max((f.after for phrase in FOREIGN if (f := phrase.match(toks, i))), default=None)
        if after is None:
            i += 1
        else:
            out[" ".join(question[toks[i].start : toks[after - 1].end].split())] = None
            i = after
    return list(out)


def other_acts(c: Column) -> Column:
    """OP-R20: acts_outside() of each question; a null question names none."""

    @F.pandas_udf("array<string>")
    def run(questions: pd.Series) -> pd.Series:
        return questions.map(lambda q: acts_outside(q or ""))

    return run(c)
