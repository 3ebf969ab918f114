"""Feeds and responses to items: XML and JSON columns parsed by Spark's own functions; what does not parse goes to quarantine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.functions.predicates import held
from intentloom.functions.text import strip_text, text_or_empty

FEED_CAP, RESULT_CAP = 15, 5
_ATOM = "entry array<struct<link:struct<_href:string>,title:string,summary:string,content:string,published:string,updated:string,author:struct<name:string>>>"
RESULTS = "results array<struct<url:string,title:string,text:string,publishedDate:string,author:string>>"
_RSS = "channel struct<item:array<struct<link:string,title:string,description:string,pubDate:string>>>"


@dataclass
class Parsed:
    """What a source sent: the items of responses that could be read, and the responses that could not (query_idx, source, fault, raw)."""

    items: DataFrame
    quarantined: DataFrame

    def faults(self) -> DataFrame:
        """(source, errors): responses in quarantine; no row where there are none."""
        return self.quarantined.groupBy("source").agg(F.count("*").alias("errors"))


def records(frame: DataFrame, raw: str, schema: str, xml: bool = False) -> DataFrame:
    """`frame` with `record`, the parsed column, and `fault`: null, `missing` for a null or blank text, or `corrupt` for one that does not parse as the schema has it.

    A record that parses in part is corrupt as a whole. Texts are parsed once, whatever is filtered by the fault later.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"}
    read = F.from_xml if xml else F.from_json
    blank = F.trim(text_or_empty(F.col(raw))) == ""
    parsed = held(F.struct(read(F.col(raw), f"{schema}, corrupt_ string", options).alias("record")))["record"]
    read_once = frame.withColumn("parsed_", parsed)
    fault = F.when(blank, "missing").when(F.col("parsed_").isNull() | F.col("parsed_.corrupt_").isNotNull(), "corrupt")
    return read_once.withColumn("fault", fault).withColumn("record", F.when(fault.isNull(), F.col("parsed_").dropFields("corrupt_"))).drop("parsed_")


def _responses(frame: DataFrame, raw: str, schema: str, xml: bool, entries: str, cap: int, source: str, **fields: str) -> Parsed:
    """First `cap` entries of each row as items; missing elements are ''."""
    read = records(frame.select("query_idx", F.col(raw).alias("raw_")), "raw_", schema, xml)
    first = read.where("fault is null").select("query_idx", F.posexplode(F.slice(f"record.{entries}", 1, cap)).alias("pos", "e"))
    cols = [strip_text(F.col(f"e.{fields[n]}")) if fields.get(n) else F.lit("") for n in ("url", "title", "text", "published", "author")]
    items = first.select(F.lit(source).alias("source"), *[c.alias(n) for c, n in zip(cols, ("url", "title", "text", "published", "author"), strict=True)], "query_idx", "pos")
    return Parsed(items, read.where("fault is not null").select("query_idx", F.lit(source).alias("source"), "fault", F.col("raw_").alias("raw")))


def feed_atom(frame: DataFrame, xml: str = "xml", cap: int = FEED_CAP, source: str = "atom") -> Parsed:
    """Atom documents (query_idx, xml) to items: link href, title, content, published, author."""
    return _responses(frame, xml, _ATOM, True, "entry", cap, source, url="link._href", title="title", text="content", published="published", author="author.name")


def feed_rss(frame: DataFrame, xml: str = "xml", cap: int = FEED_CAP, source: str = "rss") -> Parsed:
    """RSS documents to items: link text, title, description, pubDate; no author."""
    return _responses(frame, xml, _RSS, True, "channel.item", cap, source, url="link", title="title", text="description", published="pubDate")


def json_results(frame: DataFrame, json: str = "json", cap: int = RESULT_CAP, source: str = "search") -> Parsed:
    """Responses {"results": [...]} to items; a response without results is read and has none."""
    return _responses(frame, json, RESULTS, False, "results", cap, source, url="url", title="title", text="text", published="publishedDate", author="author")


def feed_atom_items(frame: DataFrame, xml: str = "xml", cap: int = FEED_CAP, source: str = "atom") -> DataFrame:
    return feed_atom(frame, xml, cap, source).items


def feed_rss_items(frame: DataFrame, xml: str = "xml", cap: int = FEED_CAP, source: str = "rss") -> DataFrame:
    return feed_rss(frame, xml, cap, source).items


def json_result_items(frame: DataFrame, json: str = "json", cap: int = RESULT_CAP, source: str = "search") -> DataFrame:
    return json_results(frame, json, cap, source).items


def xml_escaped(c: Column) -> Column:
    """Text for use inside an XML element or attribute."""
    c = text_or_empty(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
