"""HTML as flat events, and the statute and annex trees that window functions read off them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "page_id bigint, ord int, path string, tag string, cls string, text string, img string"
_KEEP = {"h1", "h2", "h3", "p", "div", "td", "th", "tr", "table", "li"}
_VOID = {"img", "br", "hr", "meta", "link", "input", "col", "area", "base", "source", "wbr"}


class _Events(HTMLParser):
    """One event for each kept element that has text of its own or images, in order of its start."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[dict] = []
        self.open: list[dict] = []
        self.hidden = 0
        self.rows = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
            return
        if tag == "img":
            if self.open:
                self.open[-1]["img"].append((named.get("src") or "").rsplit("/", 1)[-1])
            return
        if tag in _VOID:
            return
        if tag == "tr":
            self.rows += 1
        event = {"tag": tag, "cls": named.get("class") or "", "text": [], "img": [], "path": f"row{self.rows}" if tag in ("td", "th") else ""}
        if tag in _KEEP:
            self.events.append(event)
        elif self.open:
            event = self.open[-1] | {"tag": tag}
            event["text"], event["img"] = self.open[-1]["text"], self.open[-1]["img"]
        self.open.append(event)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.open and data.strip():
            self.open[-1]["text"].append(data.strip())


def events_of(html: str) -> list[dict]:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return [e for e in parser.events if e["text"] or e["img"] or e["tag"] in ("tr", "table")]


def page_events(pages: DataFrame) -> DataFrame:
    """A row for each element with text: its order, tag, class, own text and images. pages: page_id, html."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (page, i, e["path"], e["tag"], e["cls"], " ".join(e["text"]), ",".join(e["img"]))
                for page, html in zip(batch["page_id"], batch["html"])
                for i, e in enumerate(events_of(html or ""))
            ]
            yield pd.DataFrame(out, columns=["page_id", "ord", "path", "tag", "cls", "text", "img"])

    return pages.select("page_id", "html").mapInPandas(rows, EVENTS)


def statute_rows(events: DataFrame) -> DataFrame:
    """Sentences of statutes: category (last h2), title (last h3), paragraph id and section id of each text block.

    Reading stops at the first title `Schlussformel` or `Anlage…`. A block that opens with `(x)` starts section x; one without
    goes on with the section, or is section 1 at a paragraph's start. Images stand in the text as <img>name</img>.
    """
    w = Window.partitionBy("page_id").orderBy("ord")
    so_far = lambda tag: F.last(F.when(F.col("tag") == tag, F.col("text")), True).over(w)
    rows = events.withColumn("category", so_far("h2")).withColumn("title", F.coalesce(so_far("h3"), F.lit("No Paragraph Title")))
    rows = rows.withColumn("paragraph_no", F.sum((F.col("tag") == "h3").cast("int")).over(w))
    ended = F.max((F.col("tag").isin("h2", "h3") & F.col("text").rlike("^(Schlussformel|Anlage)")).cast("int")).over(w)
    rows = rows.withColumn("_ended", ended).filter("_ended = 0")
    blocks = rows.filter(F.col("tag").isin("div", "p") & (F.col("text") != ""))
    inside = Window.partitionBy("page_id", "paragraph_no").orderBy("ord")
    opened = F.nullif(F.regexp_extract("text", r"^\(([0-9a-z]+)\)", 1), F.lit(""))
    number = F.regexp_extract("title", r"§\s*\d+[a-z]?", 0)
    pictures = F.when(F.col("img") != "", F.concat(F.lit(" <img>"), "img", F.lit("</img>"))).otherwise("")
    found = blocks.select(
        "page_id", "ord", "category", F.col("title").alias("paragraph"), F.when(number != "", number).otherwise("No Paragraph ID").alias("paragraph_id"),
        F.coalesce(F.last(opened, True).over(inside), F.lit("1")).alias("sen_id"), F.concat("text", pictures).alias("text"), "paragraph_no",
    )
    joined = found.groupBy("page_id", "paragraph_no", "category", "paragraph", "paragraph_id", "sen_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return joined.select("page_id", "ord", "category", "paragraph", "paragraph_id", "sen_id", F.array_join(F.transform("x", lambda e: e["text"]), " ").alias("text"))


def annex_rows(events: DataFrame) -> DataFrame:
    """Signs of annex tables: table id carried forward, section from rows of one cell, other rows as sign number, name and description."""
    w = Window.partitionBy("page_id").orderBy("ord")
    table = F.last(F.when(F.col("text").rlike(r"^Anlage\s+\d+"), F.regexp_extract("text", r"Anlage\s+(\d+)", 1)), True).over(w)
    cells = events.withColumn("table_id", table).filter("tag IN ('td', 'th')")
    rows = cells.groupBy("page_id", "path", "table_id").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda e: e["text"]).alias("cells"))
    rows = rows.filter(F.exists("cells", lambda c: c != ""))
    w = Window.partitionBy("page_id").orderBy("ord")
    section = F.last(F.when(F.size("cells") == 1, F.get("cells", F.lit(0))), True).over(w)
    signs = rows.withColumn("section", section).filter(F.size("cells") > 1)
    wide = F.size("cells") >= 3
    at = lambda i: F.get("cells", F.lit(i))
    return signs.select("page_id", "ord", "table_id", "section", F.regexp_extract("section", r"Abschnitt\s+(\d+)", 1).alias("section_id"), at(0).alias("sign_number"), F.when(wide, at(1)).alias("sign_name"), F.when(wide, at(2)).otherwise(at(1)).alias("description"))
