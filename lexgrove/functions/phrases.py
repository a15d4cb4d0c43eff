"""Phrases over the tokens of a text, for grammars that are written as plain words.

A text is numbers, words, ordinal marks and signs. A phrase is a line of parts, separated by spaces:

    lei|leis       one of these words, without accents; with a capital (Lei) the text must have one too
    pessoais?      may be left out
    #n             a number with its ordinal mark, kept as n
    %law           a number with dots between its thousands, kept as law without them; %13709 is this number
    &n             a Roman numeral in capitals, or unico/unica
    @name          any word
    №              n, nº, no., número
    ~year          de 2018, or de 14 de agosto de 2018, with or without a comma before; kept as the year

All other parts are signs that stand for themselves.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

#: Fixed values.
ROMAN_STEPS = {"M": 1000, "CM": 900, "D": 500, "CD": 400, "C": 100, "XC": 90, "L": 50, "XL": 40, "X": 10, "IX": 9, "V": 5, "IV": 4, "I": 1}
ORDINALS, QUOTES, DASHES = "ºª°", "\"“”'‘’", "-–—"

PARTS = re.compile(rf"\d+|[{ORDINALS}]|[^\W\d_{ORDINALS}]+|\S")


def folded(text: str) -> str:
    """Lower case, without accents, ordinals as letters, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(plain.split())


def roman(n: int) -> str:
    out = ""
    for letters, worth in ROMAN_STEPS.items():
        out += letters * (n // worth)
        n %= worth
    return out


def roman_number(s: str) -> int | None:
    """The value of a numeral written as it should be, else None."""
    n, at = 0, 0
    for letters, worth in ROMAN_STEPS.items():
        while s.startswith(letters, at):
            n, at = n + worth, at + len(letters)
    return n if n and at == len(s) and roman(n) == s else None


class Token(NamedTuple):
    kind: str  # number, word, ordinal or sign
    value: str  # a word folded; quotes and dashes as one
    text: str
    start: int
    end: int
    glued: bool  # nothing stands between it and the one before


@functools.lru_cache(256)
def tokens(text: str) -> tuple[Token, ...]:
    """A text's tokens. The last texts are remembered, as one line is read in several ways."""
    out, end = [], -1
    for m in PARTS.finditer(text):
        t = m[0]
        kind = "number" if t.isdecimal() else "ordinal" if t in ORDINALS else "word" if t[0].isalpha() else "sign"
        value = folded(t) if kind == "word" else "o" if kind == "ordinal" else '"' if t in QUOTES else "-" if t in DASHES else t
        out.append(Token(kind, value, t, m.start(), m.end(), m.start() == end))
        end = m.end()
    return tuple(out)


class Found(NamedTuple):
    first: int  # token
    after: int
    values: dict[str, str]


def at(toks: tuple[Token, ...], i: int) -> Token | None:
    return toks[i] if 0 <= i < len(toks) else None


def ordinal(toks: tuple[Token, ...], i: int) -> int:
    """After the number at i and its ordinal mark, which may have a full stop."""
    t = at(toks, i + 1)
    following = at(toks, i + 2)
    if t and t.kind == "ordinal":
        return i + 2 + bool(following and following.value == "." and following.glued)
    return i + 1 + bool(t and t.text == "o" and t.glued)


def thousands(toks: tuple[Token, ...], i: int) -> tuple[str, int]:
    """The digits of the number at i with its groups of three, and the token after it."""
    digits, i = toks[i].text, i + 1
    while (dot := at(toks, i)) and dot.value == "." and dot.glued and (t := at(toks, i + 1)) and t.kind == "number" and t.glued and len(t.text) == 3:
        digits, i = digits + t.text, i + 2
    return digits, i


def date_after(toks: tuple[Token, ...], i: int) -> tuple[str, int] | None:
    """The year of a date at i, and the token after it."""
    i += bool((t := at(toks, i)) and t.value == ",")
    words = lambda k: [t.value for t in toks[i : i + k]]
    if words(1) != ["de"] or not (t := at(toks, i + 1)) or t.kind != "number":
        return None
    if len(t.text) == 4:
        return t.text, i + 2
    i = ordinal(toks, i + 1)
    year = at(toks, i + 3)
    ok = len(t.text) <= 2 and words(1) == ["de"] and (m := at(toks, i + 1)) and m.kind == "word" and toks[i + 2 : i + 3] and toks[i + 2].value == "de" and year and year.kind == "number" and len(year.text) == 4
    return (year.text, i + 4) if ok else None


class Phrase:
    def __init__(self, line: str) -> None:
        self.parts = [(p.rstrip("?") if len(p) > 1 else p, len(p) > 1 and p.endswith("?")) for p in line.split()]

    def match(self, toks: tuple[Token, ...], i: int = 0) -> Found | None:
        values: dict[str, str] = {}
        after = self._from(toks, i, 0, values)
        return None if after is None else Found(i, after, values)

    def search(self, toks: tuple[Token, ...], i: int = 0) -> Iterator[Found]:
        while i < len(toks):
            found = self.match(toks, i)
            if found and found.after > i:
                yield found
                i = found.after
            else:
                i += 1

    def _from(self, toks: tuple[Token, ...], i: int, k: int, values: dict[str, str]) -> int | None:
        if k == len(self.parts):
            return i
        part, optional = self.parts[k]
        got = self._one(part, toks, i, values)
        if got is not None and (after := self._from(toks, got, k + 1, values)) is not None:
            return after
        return self._from(toks, i, k + 1, values) if optional else None

    def _one(self, part: str, toks: tuple[Token, ...], i: int, values: dict[str, str]) -> int | None:
        t = at(toks, i)
        if t is None:
            return None
        mark, name = part[0], part[1:]
        if mark == "#" and t.kind == "number":
            values[name] = str(int(t.text))
            return ordinal(toks, i)
        if mark == "%" and t.kind == "number":
            digits, after = thousands(toks, i)
            if name.isdecimal():
                return after if digits == name else None
            values[name] = digits
            return after
        if mark == "&" and t.kind == "word" and (roman_number(t.text) or t.value in ("unico", "unica")):
            values[name] = t.text
            return i + 1
        if mark == "@" and t.kind == "word" and name:
            values[name] = t.text
            return i + 1
        if part == "№":
            if t.value not in ("n", "no", "numero"):
                return None
            i += 1
            while (t := at(toks, i)) and (t.kind == "ordinal" or t.value == "."):
                i += 1
            return i
        if mark == "~":
            found = date_after(toks, i)
            if found:
                values[name] = found[0]
            return found and found[1]
        for word in part.split("|"):
            if t.value == word.lower() and (word == word.lower() or t.text[:1].isupper()):
                return i + 1
        return None


def first_of(phrases: list[tuple[str, Phrase]], toks: tuple[Token, ...], i: int) -> tuple[str, Found] | None:
    """The name of the first phrase that stands at i, and where."""
    for name, phrase in phrases:
        if found := phrase.match(toks, i):
            return name, found
    return None


def table(lines: list[tuple[str, str]]) -> list[tuple[str, Phrase]]:
    return [(name, Phrase(line)) for name, line in lines]
