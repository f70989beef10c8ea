"""RSS 2.0 and Atom documents held in a table."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from updatelens import constants as K
from updatelens.functions import text as T
from updatelens.functions.links import resolve_url
from updatelens.functions.values import content_hash, parse_utc
from updatelens.session import materialize
from updatelens.skew import lookup

_RAW = ["external_id", "link", "title", "excerpt", "published"]


class _NoDoctype(ET.TreeBuilder):
    def doctype(self, name, pubid, system):
        raise ET.ParseError("document type declarations are refused")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _child_text(entry: ET.Element, *names: str) -> str | None:
    """Text of the first child with one of the names; earlier names win when present at all."""
    for name in names:
        for child in entry:
            if isinstance(child.tag, str) and _local(child.tag) == name.lower():
                return "".join(child.itertext())
    return None


def _atom_link(entry: ET.Element) -> str | None:
    links = entry.findall(f"{{{K.ATOM_NAMESPACE}}}link")
    preferred = sorted(links, key=lambda e: (e.get("rel") or "").lower() != "alternate")
    return next((e.get("href") for e in preferred if (e.get("href") or "").strip()), None)


def _entries(payload: str) -> list[list[str | None]] | None:
    """Raw entry fields of one document, or None when it is no supported feed."""
    try:
        root = ET.fromstring(payload, parser=ET.XMLParser(target=_NoDoctype()))
    except (ET.ParseError, ValueError):
        return None
    if _local(root.tag) == "rss":
        channels = [c for c in root if _local(c.tag) == "channel"]
        if len(channels) != 1:
            return None
        return [
            [
                _child_text(e, "guid"), _child_text(e, "link"), _child_text(e, "title"),
                _child_text(e, "description", "encoded"), _child_text(e, "pubDate"),
            ]
            for e in channels[0] if _local(e.tag) == "item"
        ]
    if root.tag == f"{{{K.ATOM_NAMESPACE}}}feed":
        return [
            [
                _child_text(e, "id"), _atom_link(e), _child_text(e, "title"),
                _child_text(e, "summary", "content"), _child_text(e, "published", "updated"),
            ]
            for e in root.findall(f"{{{K.ATOM_NAMESPACE}}}entry")
        ]
    return None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for source_id, feed_url, payload in zip(batch["source_id"], batch["feed_url"], batch["payload"]):
            found = None if payload is None else _entries(payload)
            if found is None:
                rows.append([source_id, feed_url, 0, "malformed_feed", *[None] * 5])
            else:
                rows += [[source_id, feed_url, i, None, *entry] for i, entry in enumerate(found)]
        yield pd.DataFrame(rows, columns=["source_id", "feed_url", "position", "error_code", *_RAW], dtype=object)


def parse_feeds(feeds: DataFrame, max_bytes: int = K.FEED_BYTES_MAX) -> tuple[DataFrame, DataFrame]:
    """Entries of a table of feed documents (source_id, feed_url, payload).

    Returns (items, rejects). A bad document is a reject row and leaves the others alone; the size
    limit keeps what one row can unfold to small. An entry without a title is dropped.
    """
    feeds = feeds.select("source_id", "feed_url", "payload")
    big = F.coalesce(F.octet_length("payload") > max_bytes, F.lit(False))
    source_type = feeds.schema["source_id"].dataType.simpleString()
    raw_schema = (
        f"source_id {source_type}, feed_url string, position int, error_code string, external_id string, "
        "link string, title string, excerpt string, published string"
    )
    # Written with cleaned texts: taking the two parts apart neither reads the documents twice nor cleans again for each use.
    read = feeds.where(~big).mapInPandas(_read, raw_schema).select(
        "source_id",
        "feed_url",
        "position",
        "error_code",
        T.bounded_text("external_id", K.EXTERNAL_ID_MAX).alias("external_id"),
        resolve_url(F.col("feed_url"), F.col("link")).alias("url"),
        T.bounded_text("title", K.TITLE_MAX).alias("title"),
        T.bounded_text("excerpt", K.EXCERPT_MAX).alias("excerpt"),
        parse_utc(F.col("published")).alias("published_at"),
    )
    read = materialize(read)
    rejects = read.where("error_code IS NOT NULL").select("source_id", "feed_url", "error_code").unionByName(
        feeds.where(big).select("source_id", "feed_url", F.lit("response_too_large").alias("error_code"))
    )
    fields = read.where("error_code IS NULL").drop("error_code")
    items = fields.where("title IS NOT NULL").withColumn(
        "content_hash", content_hash(F.col("title"), F.col("excerpt"))
    )
    return items, rejects


def _structure(payload: str) -> str | None:
    """Reason a document is no supported feed, or None when it is one. Reading stops at the first
    problem, but what was seen before it counts."""
    seen = {"depth": 0, "root": None, "children": set()}

    def start(name, attributes):
        parts = name.rsplit(" ", 1)
        if seen["depth"] == 0:
            seen["root"] = (parts[0] if len(parts) == 2 else "", parts[-1].lower())
        elif seen["depth"] == 1:
            seen["children"].add(parts[-1].lower())
        seen["depth"] += 1

    def end(name):
        seen["depth"] -= 1

    def doctype(*_):
        raise ValueError("document type declarations are refused")

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartDoctypeDeclHandler = doctype
    well_formed = True
    try:
        parser.Parse(payload, True)
    except (expat.ExpatError, ValueError):
        well_formed = False
    namespace, root = seen["root"] or ("", "")
    if root == "rss":
        need = {"channel"}
    elif root == "feed" and namespace == K.ATOM_NAMESPACE:
        need = {"id", "title", "updated"}
    else:
        return "unsupported_root" if well_formed else "malformed_xml"
    missing = need - seen["children"]
    return "missing_" + "_".join(sorted(missing)) if missing else None


@F.pandas_udf(StringType())
def _structure_reason(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: "malformed_xml" if p is None else _structure(p) or "")


def classify_feeds(feeds: DataFrame, max_bytes: int = K.FEED_BYTES_MAX) -> DataFrame:
    """Whether each document has the structure of a supported feed, and why not."""
    big = F.coalesce(F.octet_length("payload") > max_bytes, F.lit(False))
    found = _structure_reason(F.when(~big, F.col("payload")))
    reason = F.when(big, F.lit("response_too_large")).otherwise(F.when(found != "", found))
    judged = feeds.select("source_id", reason.alias("reason"))
    return judged.select("source_id", F.col("reason").isNull().alias("is_supported"), "reason")


def payload_validator() -> Column:
    """Validator of a payload, cut to the stored length."""
    return F.substring(F.sha2("payload", 256), 1, K.VALIDATOR_MAX)


def unchanged_filter(feeds: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split payloads into (to process, not modified) by the validator stored for their source.

    ``sources`` has source_id and validator; a source without one is always processed.
    """
    stored = sources.select("source_id", F.col("validator").alias("_stored"))
    marked = lookup(feeds.withColumn("validator", payload_validator()), stored, ["source_id"], F.col("validator"))
    same = F.coalesce(F.col("validator") == F.col("_stored"), F.lit(False))
    return marked.where(~same).drop("_stored"), marked.where(same).drop("_stored")
