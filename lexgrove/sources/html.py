"""HTML pages as lines (OP-S04 to S09): a page is read once, by events, without building a tree.

Only line-break tags and the edges of block elements end a line; inline elements join without a
separator; white space runs are one space. Script, style, head and noscript don't count. Struck text
(by tag or by an inline line-through) is left out of lines; a line that is struck as a whole is a
block with struck = true. An end tag closes the innermost open element of its name and what is open
within; without one it closes nothing. A container that isn't there gives an error instead of lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
STRUCK = {"strike", "s", "del"}
SKIPPED = {"script", "style", "head", "noscript"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "table", "tr", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"plain": None, "gazette": ("div", "class", "texto-dou"), "portal": (None, "id", "page-document")}
#: Bytes in which a page may declare its charset.
DECLARED_WITHIN = 4096


def strikes(style: str) -> bool:
    """If an element's style draws a line through its text."""
    rules = (rule.lower().partition(":") for rule in style.split(";"))
    return any(name.strip() == "text-decoration" and "line-through" in value for name, _, value in rules)


class CharsetReader(HTMLParser):
    """The charset of the first meta element that has one, of its own or in its content."""

    def __init__(self):
        super().__init__()
        self.name: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag != "meta" or self.name:
            return
        attrs = dict(attrs)
        pair = next((p for p in (attrs.get("content") or "").lower().split(";") if p.strip().startswith("charset")), "")
        self.name = (attrs.get("charset") or pair.partition("=")[2]).strip() or None


class LineReader(HTMLParser):
    def __init__(self, layout: str):
        super().__init__(convert_charrefs=True)
        self.wanted = CONTAINERS[layout]
        self.found = self.done = False
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, struck, skipped, container
        self.plain: list[str] = []
        self.struck: list[str] = []
        self.blocks: list[tuple[str, bool]] = []

    def inside(self) -> bool:
        return self.wanted is None or any(e[3] for e in self.open)

    def end_line(self) -> None:
        plain, struck = (" ".join("".join(x).split()) for x in (self.plain, self.struck))
        if plain or struck:
            self.blocks.append((plain, False) if plain else (struck, True))
        self.plain, self.struck = [], []

    def is_container(self, tag: str, attrs: dict) -> bool:
        if self.wanted is None or self.found:
            return False
        name, attribute, value = self.wanted
        return (name is None or name == tag) and value in (attrs.get(attribute) or "").split()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "br" or tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        container = self.is_container(tag, attrs)
        self.found |= container
        struck = tag in STRUCK or strikes(attrs.get("style") or "")
        self.open.append((tag, struck, tag in SKIPPED, container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            if any(e[0] in BLOCKS for e in self.open[at:]):
                self.end_line()
            del self.open[at:]

    def handle_data(self, data):
        if self.inside() and not any(e[2] for e in self.open):
            (self.struck if any(e[1] for e in self.open) else self.plain).append(data)


def page_blocks(html: str, layout: str = "plain") -> list[tuple[str, bool]]:
    """(line, struck) of a page; LookupError without the layout's container."""
    reader = LineReader(layout)
    reader.feed(html)
    reader.close()
    reader.end_line()
    if reader.wanted is not None and not reader.found:
        raise LookupError(f"no container of layout {layout}")
    return reader.blocks


def decoded(raw: bytes) -> str:
    """By the charset a page declares, else UTF-8, else windows-1252."""
    reader = CharsetReader()
    reader.feed(raw[:DECLARED_WITHIN].decode("latin-1"))
    for name in [*([reader.name] if reader.name else []), "utf-8", "windows-1252"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw.decode("windows-1252", errors="replace")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", layout: str = "plain") -> DataFrame:
    """page_id, line_no (from 0), line, struck, error. html: text or bytes; a null page has no lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, body in zip(batch["page_id"], batch["html"]):
                try:
                    blocks = [] if body is None else page_blocks(body if isinstance(body, str) else decoded(bytes(body)), layout)
                    out += [(page, i, line, struck, None) for i, (line, struck) in enumerate(blocks)]
                except LookupError as e:
                    out.append((page, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["page_id", "line_no", "line", "struck", "error"]).astype({"line_no": "Int64", "struck": "boolean"})

    slim = pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).alias("html"))
    return slim.mapInPandas(run, "page_id long, line_no long, line string, struck boolean, error string")


def html_lines(pages: DataFrame, **options) -> DataFrame:
    """page_id, line_no, line: what isn't struck, numbered among all blocks."""
    return html_blocks(pages, **options).where("not struck").select("page_id", "line_no", "line")
