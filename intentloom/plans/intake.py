"""Queries on intake: feeds, responses, unions, caps and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.operators import intake
from intentloom.plans import bindings as B
from intentloom.sources import feeds

TEXT = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def _packed(spark, d, entry, head, tail):
    """benchmark as feeds of 20 entries."""
    rows = B.table(spark, d, "benchmark").withColumn("query_idx", F.expr("cast(item_id div 20 as int)")).select("query_idx", "item_id", entry.alias("entry"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("item_id", "entry"))), lambda x: x["entry"])
    return rows.groupBy("query_idx").agg(F.concat(F.lit(head), F.array_join(parts, ""), F.lit(tail)).alias("xml"))


def a1(spark, d):
    text, n = feeds.xml_escaped(F.col("text")), F.col("item_id").cast("string")
    entry = F.concat(F.lit('<entry><link href="https://b.example/'), n, F.lit('"/><title>Item '), n, F.lit("</title><content>"), text, F.lit("</content><author><name>A"), n, F.lit("</name></author></entry>"))
    packed = _packed(spark, d, entry, '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>")
    return feeds.feed_atom_items(packed)


def a2(spark, d):
    text, n = feeds.xml_escaped(F.col("text")), F.col("item_id").cast("string")
    entry = F.concat(F.lit("<item><link>https://b.example/"), n, F.lit("</link><title>Item "), n, F.lit("</title><description>"), text, F.lit("</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    packed = _packed(spark, d, entry, '<rss version="2.0"><channel>', "</channel></rss>")
    return feeds.feed_rss_items(packed)


def a3(spark, d):
    one = F.struct(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), "text")
    rows = B.table(spark, d, "documents").withColumn("query_idx", F.expr("cast(doc_id div 8 as int)"))
    packed = rows.groupBy("query_idx").agg(F.sort_array(F.collect_list(F.struct("doc_id", one.alias("r")))).alias("all"))
    reply = F.to_json(F.struct(F.transform("all", lambda x: x["r"]).alias("results")))
    reply = F.when(F.col("query_idx") % 10 == 9, F.lit("{not json")).otherwise(reply)
    return feeds.json_result_items(packed.select("query_idx", reply.alias("json")))


def a3b(spark, d):
    """Every response once: with the items it has, or its fault."""
    replies = B.table(spark, d, "documents").groupBy(F.expr("cast(doc_id div 8 as int)").alias("query_idx")).agg(F.count("*").alias("n"), F.min("text").alias("text"))
    good = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.struct(F.concat(F.lit("u"), i.cast("string")).alias("url"), F.col("text").alias("text"))).alias("results")))
    q = F.col("query_idx") % 10
    raw = F.when(q == 9, "{not json").when(q == 7, F.lit(None)).when(q == 5, F.substr(good, F.lit(1), F.length(good) - 1)).when(q == 3, '{"results": 5}').when(q == 1, "{}").otherwise(good)
    parsed = feeds.json_results(replies.select("query_idx", raw.alias("json")))
    counts = parsed.items.groupBy("query_idx").agg(F.count("*").alias("items"))
    return counts.select("query_idx", "items", F.lit(None).cast("string").alias("fault")).unionByName(parsed.quarantined.select("query_idx", F.lit(0).cast("long").alias("items"), "fault"))


def a4(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    bench = B.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return intake.union_items(documents=docs, benchmark=bench).select("source", "id", "text")


def a6(spark, d):
    docs = B.table(spark, d, "documents")
    specs = docs.select(F.col("doc_id").cast("int").alias("query_idx"), F.col("source").alias("query"), F.when(F.col("doc_id") % 3 > 0, F.array(F.concat("lang", F.lit(".example")), F.concat("source", F.lit(".example")))).alias("domains"))
    return intake.query_catalog_explode(specs)


def a7(spark, d):
    pages = B.table(spark, d, "pages")
    hosts = pages.where("page_id % 25 = 0").select(F.regexp_replace(intake.host_of(F.col("url")), r"^[^.]+\.", "").alias("domain"))
    return intake.domain_allow_filter(pages, hosts).select("page_id", "url")


def a8(spark, d):
    docs = B.table(spark, d, "documents").select((F.col("doc_id") + 1).alias("pos"), "source")
    return intake.bridge_query_select(docs, docs.count())


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
_FEED = "(select *, row_number() over (partition by item_id // 20 order by item_id) as n from benchmark) where n <= 15"
QUERIES = {
    "a1_feed_atom_items": a1,
    "a2_feed_rss_items": a2,
    "a3_json_result_items": a3,
    "a3b_quarantine": a3b,
    "a4_union_items": a4,
    "a5_cap_per_source": lambda s, d: intake.cap_per_source(B.table(s, d, "documents"), "source", "doc_id", 15).select("source", "doc_id"),
    "a6_query_catalog_explode": a6,
    "a7_domain_allow_filter": a7,
    "a8_bridge_query_select": a8,
    "a10_require_fields": lambda s, d: intake.require_fields(B.table(s, d, "pages").withColumn("url", F.when(F.col("page_id") % 5 > 0, F.col("url"))), "url", "html").select("page_id", "url"),
}
SQL = {
    "a1_feed_atom_items": f"select 'atom' as source, 'https://b.example/' || item_id as url, 'Item ' || item_id as title, {TEXT} as text, '' as published, 'A' || item_id as author, cast(item_id // 20 as integer) as query_idx, cast(n - 1 as integer) as pos from {_FEED}",
    "a2_feed_rss_items": f"select 'rss' as source, 'https://b.example/' || item_id as url, 'Item ' || item_id as title, {TEXT} as text, 'Mon, 01 Jan 2024 00:00:00 GMT' as published, '' as author, cast(item_id // 20 as integer) as query_idx, cast(n - 1 as integer) as pos from {_FEED}",
    "a3_json_result_items": f"select 'search' as source, 'doc://' || doc_id as url, source as title, {TEXT} as text, '' as published, '' as author, cast(q as integer) as query_idx, cast(n - 1 as integer) as pos from (select doc_id, source as s, text, doc_id // 8 as q, row_number() over (partition by doc_id // 8 order by doc_id) as n, source from documents) where n <= 5 and q % 10 <> 9".replace("source as title", "s as title", 1),
    "a3b_quarantine": """with r as (select cast(doc_id // 8 as integer) as query_idx, count(*) as n from documents group by 1)
  select query_idx, case when query_idx % 10 in (3, 5, 7, 9) then 0 else least(n, 5) end as items, case query_idx % 10 when 7 then 'missing' when 3 then 'corrupt' when 5 then 'corrupt' when 9 then 'corrupt' end as fault from r where query_idx % 10 <> 1""",
    "a4_union_items": "select 'documents' as source, doc_id as id, text from documents union all select 'benchmark', item_id, text from benchmark",
    "a5_cap_per_source": "select source, doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 15",
    "a6_query_catalog_explode": "select cast(doc_id as integer) as query_idx, source as query, lang || '.example' as domain from documents where doc_id % 3 > 0 union all select cast(doc_id as integer), source, source || '.example' from documents where doc_id % 3 > 0 union all select cast(doc_id as integer), source, null from documents where doc_id % 3 = 0",
    "a7_domain_allow_filter": f"with h as (select page_id, url, {_HOST} as host from pages), d as (select distinct regexp_replace(host, '^[^.]+\\.', '') as domain from h where page_id % 25 = 0) select page_id, url from h where exists (select 1 from d where host = domain or ends_with(host, '.' || domain))",
    "a8_bridge_query_select": "select doc_id + 1 as pos, source from documents where doc_id % 10 >= 6 and ceil((doc_id + 1) / 10.0) * 10 <= (select count(*) from documents)",
    "a10_require_fields": "select page_id, url from pages where page_id % 5 > 0 and length(url) > 0 and length(html) > 0",
}
