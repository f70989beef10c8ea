"""Readable title and text of web pages held in a table."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.functions.values import sha256_upper
from updatelens.session import materialize

# Elements that carry no article text, elements without an end tag, and elements
# whose start ends an open paragraph.
_DROPPED = set("script style noscript template head nav header footer aside form".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary "
    "table ul".split()
)
_AT_ONCE = 64
# Elements that may stand in a document head.
_HEAD_ONLY = set("base basefont bgsound link meta noscript script style template title head html".split())


class _Page(HTMLParser):
    """One pass over a page. Open elements form a stack; text goes to every open candidate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.og_title: str | None = None
        self.og_seen = False
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self.body: list[str] = []
        self.article: dict | None = None
        self.main: dict | None = None
        self.containers: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and not self.og_seen:
            values = {k: v or "" for k, v in attrs}
            if "og:title" in (values.get("property", "").lower(), values.get("name", "").lower()):
                self.og_seen, self.og_title = True, values.get("content")
        if tag in _ENDS_PARAGRAPH and any(e["tag"] == "p" for e in self.stack):
            self._close("p")
        if tag not in _HEAD_ONLY and self.stack and self.stack[-1]["tag"] == "head":
            self.stack.pop()
        if tag in _VOID:
            return
        dropped = tag in _DROPPED or bool(self.stack and self.stack[-1]["dropped"])
        element = {"tag": tag, "dropped": dropped, "text": [], "paragraph": 0}
        if not dropped:
            if tag == "article" and self.article is None:
                self.article = element
            elif tag == "main" and self.main is None:
                self.main = element
            if tag in ("div", "section"):
                self.containers.append(element)
        if tag == "title" and self.title is None and not any(e["tag"] == "svg" for e in self.stack):
            self.title = element["text"]
        if tag == "h1" and self.h1 is None:
            self.h1 = element["text"]
        self.stack.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):
            self._close(tag)

    def _close(self, tag):
        while self.stack.pop()["tag"] != tag:
            pass

    def handle_data(self, data):
        inside = bool(self.stack) and self.stack[-1]["dropped"]
        in_title = any(e["tag"] == "title" for e in self.stack)
        in_paragraph = any(e["tag"] == "p" for e in self.stack)
        for element in self.stack:
            if element["tag"] in ("title", "h1"):
                element["text"].append(data)
            elif not inside and not in_title and element["tag"] in ("article", "main", "div", "section"):
                element["text"].append(data)
                element["paragraph"] += len(data) if in_paragraph else 0
        if not inside and not in_title:
            self.body.append(data)


def _squeeze(parts: list[str] | None) -> str | None:
    return " ".join("".join(parts).split()) or None if parts else None


def _extract(html: str) -> tuple[str | None, str | None]:
    page = _Page()
    page.feed(html)
    page.close()
    title = _squeeze([page.og_title]) if page.og_title else None
    title = title or _squeeze(page.title) or _squeeze(page.h1)
    chosen = page.article or page.main
    if chosen is None:
        densest = max(page.containers, key=lambda e: e["paragraph"], default=None)
        chosen = densest if densest and densest["paragraph"] > 0 else {"text": page.body}
    return title, _squeeze(chosen["text"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Title and text of each page. Few pages at a time are held as Python strings."""
    for batch in batches:
        for start in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(start, _AT_ONCE)
            found = [(None, None) if h is None else _extract(h) for h in part.column("html").to_pylist()]
            titles, texts = (pa.array([f[k] for f in found], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), titles, texts], ["page_id", "url", "title", "text"]
            )


def extract_articles(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title and text of pages (page_id, url, html). Returns (articles, rejects): a page without a
    usable title or text is a reject."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, url string, title string, text string"
    # Written, so that taking the two parts apart does not read the pages twice.
    read = materialize(pages.select("page_id", "url", "html").mapInArrow(_read, schema))
    usable = F.col("title").isNotNull() & F.col("text").isNotNull()
    rejects = read.where(~usable).select("page_id", "url", F.lit("not_extractable").alias("error_code"))
    return read.where(usable), rejects


def article_items(articles: DataFrame) -> DataFrame:
    """Item fields of extracted articles. The digest covers the whole text, the excerpt its start."""
    return articles.select(
        "page_id",
        "url",
        T.clamp("title", K.TITLE_MAX).alias("title"),
        T.clamp("text", K.EXCERPT_MAX).alias("excerpt"),
        sha256_upper("text").alias("content_hash"),
    )
