"""Reports as text columns (OP-S25 to S29, E04, E08, C13, A22)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LONGEST = 600


def percent(c: Column) -> Column:
    return F.when(c.isNull(), "–").otherwise(F.format_string("%.1f %%", c * 100))


def markdown(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, text: a table of a small report, in order; null cells are dashes, bars are escaped."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("–")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    body = rows.select(F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return body.select(F.array_join(F.concat(F.array(F.lit(head)), F.transform("x", lambda x: x["l"])), "\n").alias("text"))


def badge(value: Column, label: str, good: float, fair: float) -> Column:
    """OP-S26: JSON of a badge: green from good on, yellow from fair on, else red."""
    color = F.when(value >= good, "brightgreen").when(value >= fair, "yellow").otherwise("red")
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit(label).alias("label"), percent(value).alias("message"), color.alias("color")))


def search_lines(provisions: DataFrame) -> DataFrame:
    """OP-S28: value: one JSON object for each provision in force: id, path, text."""
    return provisions.where("not revoked and not vetoed").select(F.to_json(F.struct("id", "path", "text")).alias("value"))


def cut(c: Column) -> Column:
    """At most LONGEST characters, in a fence that the text can't close."""
    short = F.when(F.length(c) > LONGEST, F.concat(F.left(c, F.lit(LONGEST)), F.lit("…"))).otherwise(c)
    return F.concat(F.lit("~~~text\n"), F.replace(F.coalesce(short, F.lit("")), F.lit("~~~"), F.lit("~ ~ ~")), F.lit("\n~~~"))


def change_entries(changes: DataFrame) -> DataFrame:
    """OP-S29: document_id, id, value: an entry for each change (document_id, id, change, old, new)."""
    value = F.concat_ws("\n\n", F.concat(F.lit("### "), "id", F.lit(" ("), "change", F.lit(")")), F.when(F.col("old").isNotNull(), cut(F.col("old"))), F.when(F.col("new").isNotNull(), cut(F.col("new"))))
    return changes.select("document_id", "id", value.alias("value"))


def headings_on_change(provisions: DataFrame) -> DataFrame:
    """OP-W08, I06: id, headings: of a provision's headings (its path but for the labels of its own levels) those from the first one that the provision before it hasn't."""
    levels = F.size(F.filter(F.split("id", ":"), lambda x: ~x.startswith("anx"))) - 1
    own = provisions.select("document_id", "ordinal", "id", F.slice("path", F.lit(1), F.greatest(F.size("path") - levels, F.lit(0))).alias("_h"))
    order = W.partitionBy("document_id").orderBy("ordinal", "id")
    before = own.withColumn("_b", F.coalesce(F.lag("_h").over(order), F.array().cast("array<string>")))
    same = F.transform("_h", lambda h, i: (F.size("_b") > i) & F.get("_b", i).eqNullSafe(h))
    first = F.array_position(same, False)
    return before.withColumn("_f", first).select("id", F.when(F.col("_f") > 0, F.slice("_h", F.col("_f").cast("int"), F.size("_h"))).otherwise(F.array().cast("array<string>")).alias("headings"))


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


LINK = "array<struct<start: int, end: int, target: string>>"


def spliced(text: Column, links: Column) -> Column:
    """OP-C08: escaped HTML of a text with links at their offsets (code points). Of links that overlap the first stays; those that don't lie in the text go."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, every: pd.Series) -> pd.Series:
        def one(text: str | None, own) -> str:
            text, out, at = text or "", [], 0
            for link in sorted([] if own is None else own, key=lambda x: (x["start"], -x["end"])):
                a, b = link["start"], link["end"]
                if at <= a < b <= len(text):
                    out += [html.escape(text[at:a]), f'<a href="#{html.escape(link["target"])}">{html.escape(text[a:b])}</a>']
                    at = b
            return "".join([*out, html.escape(text[at:])])

        return pd.Series([one(t, x) for t, x in zip(texts, every)])

    return run(text, links)


def earlier_wordings(versions: DataFrame) -> DataFrame:
    """OP-S31: id, earlier: a folded block of a provision's wordings before its last one, oldest first, each with its days and the act that brought it."""
    day = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy"), F.lit("?"))
    own = versions.withColumn("_last", F.max("seq").over(W.partitionBy("id"))).where(F.col("seq") < F.col("_last"))
    by = F.coalesce(F.concat(F.lit(" ("), escaped(F.col("introduced_by")), F.lit(")")), F.lit(""))
    line = F.concat(F.lit("<p>"), day("valid_from"), F.lit(" – "), day("valid_to"), by, F.lit(": "), escaped(F.coalesce("text", F.lit(""))), F.lit("</p>"))
    lines = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))).alias("_l"))
    return lines.select("id", F.concat(F.lit("<details><summary>Redações anteriores</summary>"), F.array_join(F.transform("_l", lambda x: x["l"]), ""), F.lit("</details>")).alias("earlier"))


def act_pages(provisions: DataFrame, links: DataFrame | None = None, versions: DataFrame | None = None, headings: bool = False) -> DataFrame:
    """OP-S27, S31, A22: document_id, in_force, html: an act's provisions in order, marked where they no longer hold.

    links: source, start, end, target, as the edges of cross-references; versions: as temporal.dated() gives them; headings: print them where they change.
    """
    status = F.when(F.col("revoked"), " <em>revogado</em>").when(F.col("vetoed"), " <em>vetado</em>").otherwise("")
    own, body, more, lead = provisions, escaped(F.coalesce("text", F.lit(""))), F.lit(""), F.lit("")
    if links is not None:
        own = own.join(links.groupBy(F.col("source").alias("id")).agg(F.collect_list(F.struct("start", "end", "target")).alias("_links")), "id", "left")
        body = spliced(F.col("text"), F.col("_links").cast(LINK))
    if versions is not None:
        own = own.join(earlier_wordings(versions), "id", "left")
        more = F.coalesce("earlier", F.lit(""))
    if headings:
        own = own.join(headings_on_change(provisions), "id", "left")
        lead = F.array_join(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.concat(F.lit("<h2>"), escaped(h), F.lit("</h2>"))), "")
    block = F.concat(lead, F.lit('<p id="'), "id", F.lit('"><b>'), escaped(F.col("label")), F.lit("</b>"), status, F.lit(" "), body, F.lit("</p>"), more)
    each = own.withColumn("_block", block).groupBy("document_id").agg(F.count_if(~F.col("revoked") & ~F.col("vetoed")).alias("in_force"), F.array_sort(F.collect_list(F.struct("ordinal", "id", F.col("_block").alias("b")))).alias("_b"))
    return each.select("document_id", "in_force", F.array_join(F.transform("_b", lambda x: x["b"]), "\n").alias("html"))


def failed_gates(metrics: DataFrame, least: dict[str, float]) -> DataFrame:
    """OP-E08: metric, value, least: what lies below its bound; a metric without a value fails."""
    one = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("least")) for m, x in least.items()]
    return metrics.select(F.inline(F.array(*one))).where("value is null or value < least")
