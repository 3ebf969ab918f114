"""Queries on sinks, run counts and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from intentloom.functions import predicates as P
from intentloom.functions.lexicons import PROSE_CHAT, PROSE_WEB as LEX
from intentloom.operators import identity, leads, ledger, run, summary
from intentloom.plans import bindings as B
from intentloom.plans import chat, web
from intentloom.session import delete, work_folder
from intentloom.sources import feeds
from intentloom.streaming import streams


def f5(spark, d):
    """Two runs into an empty store: the even documents first, then all; then the second run again, and compaction. Leads are made once, for all of them."""
    path, made = work_folder(spark, "store"), work_folder(spark, "leads")
    found = web.all_leads(spark, d)
    found.write.parquet(made)
    found = spark.read.schema(found.schema).parquet(made)
    leads.lead_sink(found.where("doc_id % 2 = 0"), path, "run1", prefix=1)
    for _ in range(2):
        leads.lead_sink(found, path, "run2", prefix=1)
    delete(spark, made)
    ledger.compact(spark, path, files=1)
    return spark.read.parquet(path).select("doc_id", "lead_id", "run_id")


def f6(spark, d):
    """The scan log after the same scan was written twice."""
    path = work_folder(spark, "log")
    log = g5(spark, d)
    leads.scan_log_sink(log, path)
    leads.scan_log_sink(log, path)
    return spark.read.parquet(path).select(F.col("scan_id").cast("string").alias("scan_id"), "status", "queries", "new_hot_warm")


def g4(spark, d):
    return summary.chat_counts(chat.scored(spark, d), P.label_filter(F.col("classification")))


def g5(spark, d):
    """The record of a run over all tables: distinct results are observed while leads are counted."""
    docs, seen = B.items(spark, d), Observation()
    new = summary.new_lead_counts(web.all_leads(spark, d, seen)).first()[0]
    counted = spark.createDataFrame([(seen.get["unique_results"], new)], "unique_results long, new_hot_warm long")
    parts = {
        "counted": counted, "chat": g4(spark, d),
        "failed": summary.failure_counts(g6(spark, d), "event_type"),
        "sources": summary.counts_map(summary.source_counts(docs).withColumnRenamed("n", "source_counts"), "source", "source_counts"),
    }
    done = summary.scan_summary(B.AS_OF, datetime(2024, 1, 31, 0, 5), 33, **parts)
    return done.select("scan_id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "queries", "unique_results", "new_hot_warm", "chat_groups", "chat_messages", "chat_leads", F.to_json("source_counts").alias("source_counts"), "errors", F.to_json("source_errors").alias("source_errors"), "chat_status")


def g6(spark, d):
    """Failures per event type: properties that are cut off, and some that are not there."""
    events = B.table(spark, d, "events")
    props = F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("props"))
    return summary.error_counts(feeds.records(events.withColumn("raw", props), "raw", "k long"), "event_type", F.col("fault").isNotNull())


def g2b(spark, d):
    """Distinct results of two runs together from the sketches of their records, beside the exact count."""
    pages = B.table(spark, d, "pages").withColumn("title", F.lit("")).withColumn("author", F.lit(""))
    log = summary.unique_sketch(pages.where("page_id % 3 <> 0")).unionByName(summary.unique_sketch(pages.where("page_id % 3 <> 1")))
    both = summary.unique_results(pages).withColumnRenamed("unique_results", "exact").withColumn("k", F.lit(1)).join(summary.unique_over_runs(log).withColumn("k", F.lit(1)), "k")
    return both.select("exact", (F.abs(F.col("unique_results") - F.col("exact")) <= 0.02 * F.col("exact")).alias("near"))


def _run(spark, d):
    """A run over documents as search hits, benchmark as news and conversations as messages."""
    news = B.table(spark, d, "benchmark").select(
        F.lit("news").alias("source"), F.col("text").alias("url"), F.lit("").alias("title"), "text", F.lit("").alias("published"), F.lit("").alias("author"),
        F.lit(10).alias("query_idx"), F.col("item_id").cast("int").alias("pos"),
    )
    search = B.items(spark, d).withColumn("url", F.col("text")).drop("doc_id")
    folder = work_folder(spark, "run")
    sources = sorted(r[0] for r in search.select("source").distinct().collect())
    failures = spark.createDataFrame([("news", 2), ("feed", 1)], "source string, errors long")
    return run.scan(
        search, news, B.messages(spark, d), LEX, PROSE_CHAT, datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 12, 5), 33, f"{folder}/store", f"{folder}/log", per_group=5, failures=failures, sources=["news", *sources], prefix=1,
    )


def r1(spark, d):
    return _run(spark, d).web.select("source", "lead_id", "market", "route_to", "intent_score", "classification")


def r2(spark, d):
    return _run(spark, d).record.select("scan_id", "unique_results", "new_hot_warm", "chat_groups", "chat_messages_scanned", "chat_new_hot_warm", "errors", F.col("source_errors")["news"].alias("news_errors"), "chat_status", F.to_json("source_counts").alias("source_counts"), "results_per_query")


def h1(spark, d):
    """Scoring of documents as a stream; equals the batch."""
    raw = streams.read_files(spark, f"{d}/documents.parquet")
    items = raw.select("source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), "text", F.lit("").alias("author"), "doc_id")
    found = streams.stream_score(items, lambda x: leads.scored_items(x, LEX).where(P.label_filter(F.col("classification"))).select("doc_id", "intent_score", "classification"))
    folder = work_folder(spark, "scored")
    return streams.run_to_table(found, f"{folder}/out", f"{folder}/checkpoint")


def h2(spark, d):
    raw = streams.read_files(spark, f"{d}/events.parquet")
    folder = work_folder(spark, "first")
    found = streams.run_to_table(streams.stream_dedup(raw, ["user_id", "event_type"]).select("user_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint")
    return found.select("user_id", "event_type")


def h2b(spark, d):
    """First sights of a user's kind of event, three days apart, over a stream of eight files; every eleventh event of the last hours of a file comes with the next one."""
    folder, day = work_folder(spark, "sights"), F.unix_date(F.to_date("ts"))
    events = B.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    low = events.agg(F.min(day)).first()[0]
    part = F.floor((day - F.lit(low)) / 4)
    late = (F.col("event_id") % 11 == 0) & ((day - F.lit(low)) % 4 == 3) & (F.hour("ts") >= 12)
    dealt = events.withColumn("part", F.least(F.when(late, part + 1).otherwise(part), F.lit(7)))
    for i in range(8):
        dealt.where(F.col("part") == i).drop("part").repartition(1).write.mode("append").parquet(f"{folder}/in")
    raw = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = streams.run_to_table(streams.stream_first_sights(raw, ["user_id", "event_type"], horizon="3 days"), f"{folder}/out", f"{folder}/checkpoint")
    return found.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sight"))


def h3(spark, d):
    """The ledger after the stream has run twice from nothing."""
    raw = streams.read_files(spark, f"{d}/documents.parquet")
    keyed = raw.select(identity.fingerprint(F.col("text"), F.lit(""), F.lit("")).alias("lead_id"))
    folder = work_folder(spark, "ledger")
    for n in (1, 2):
        streams.stream_ledger(keyed, f"{folder}/ledger", f"{folder}/checkpoint{n}", prefix=1)
    return spark.read.parquet(f"{folder}/ledger").select("lead_id")


def h4(spark, d):
    raw = streams.read_files(spark, f"{d}/events.parquet")
    folder = work_folder(spark, "counts")
    found = streams.run_to_table(streams.stream_counts(raw, "event_type"), f"{folder}/out", f"{folder}/checkpoint")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


QUERIES = {
    "f5_lead_sink": f5,
    "f6_scan_log_sink": f6,
    "g1_source_counts": lambda s, d: summary.source_counts(B.items(s, d)),
    "g2_unique_results": lambda s, d: summary.unique_results(B.table(s, d, "pages").withColumn("title", F.lit("")).withColumn("author", F.lit(""))),
    "g2b_unique_over_runs": g2b,
    "g3_new_lead_counts": lambda s, d: summary.new_lead_counts(web.all_leads(s, d)),
    "g4_chat_counts": g4,
    "g5_scan_summary": g5,
    "g6_error_counts": g6,
    "r1_scan_leads": r1,
    "r2_scan_record": r2,
    "h1_stream_score": h1,
    "h2_stream_dedup": h2,
    "h2b_stream_first_sights": h2b,
    "h3_stream_ledger": h3,
    "h4_stream_counts": h4,
}
_WEB = f"with {web.LABELLED_SQL}, leads as (select * from labelled where classification in ('HOT', 'WARM'))"
_CHAT = f"(with {chat.LABELLED_SQL} select count(distinct group_id) as g, count(*) as m, count(*) filter (where classification in ('HOT', 'WARM')) as l from labelled)"
_RUN = f"""with items as (select source, text as url, '' as title, text, '' as author, 0 as so, doc_id % 33 + 1 as query_idx, doc_id as pos, doc_id, lower(' ' || text) as blob from documents
  union all select 'news', text, '', text, '', 1, 10, item_id, null, lower(' ' || text) from benchmark), {web.LABELLED_SQL.split("from documents),", 1)[1]},
  leads as (select * from (select *, row_number() over (partition by lead_id order by ceil(query_idx / 10.0), so, query_idx, pos) as nth from labelled where url <> '')
    where nth = 1 and (so = 1 or ({web._GATE})) and classification in ('HOT', 'WARM'))"""
# Of each group the newest 5 messages, empty ones counted; of these the ones with text, of the last day.
_RECENT = f"""(with {chat.LABELLED_SQL} select * from (select *, row_number() over (partition by group_id order by message_id desc) as back from labelled)
  where back <= 5 and text <> '' and 1704067200 + group_id * 60 + message_id >= 1704067200 - 43200)"""
SQL = {
    "r1_scan_leads": _RUN + " select source, lead_id, market, route_to, intent_score, classification from leads",
    "r2_scan_record": _RUN + f""" select '20240101T120000Z' as scan_id, (select count(distinct lead_id) from labelled where url <> '') as unique_results, (select count(*) from leads) as new_hot_warm,
  (select count(distinct conv_id) from conversations) as chat_groups, count(*) as chat_messages_scanned, count(*) filter (where classification in ('HOT', 'WARM')) as chat_new_hot_warm,
  3 as errors, 2 as news_errors, 'completed' as chat_status, 5 as results_per_query,
  '{{"Chat":' || count(*) filter (where classification in ('HOT', 'WARM')) || ',' || (select string_agg('"' || source || '":' || n, ',' order by source) from
    (select source, count(*) as n from (select source from documents union all select 'news' from benchmark) group by source)) || '}}' as source_counts from {_RECENT}""",
    "f5_lead_sink": _WEB + " select doc_id, lead_id, case when doc_id % 2 = 0 then 'run1' else 'run2' end as run_id from leads",
    "f6_scan_log_sink": _WEB + " select '20240131T000000Z' as scan_id, 'completed' as status, 33 as queries, count(*) as new_hot_warm from leads",
    "g1_source_counts": "select source, count(*) as n from documents group by source",
    "g2_unique_results": "select count(distinct lower(url)) as unique_results from pages where url <> ''",
    "g2b_unique_over_runs": "select count(distinct lower(url)) as exact, true as near from pages where url <> ''",
    "g3_new_lead_counts": _WEB + " select count(*) as new_hot_warm from leads",
    "g4_chat_counts": f"select g as chat_groups, m as chat_messages, l as chat_leads from {_CHAT}",
    "g5_scan_summary": _WEB + f""" select '20240131T000000Z' as scan_id, 'completed' as status, '{B.FOUND_AT}' as started_at, 33 as queries, (select count(*) from documents) as unique_results,
  (select count(*) from leads) as new_hot_warm, g as chat_groups, m as chat_messages, l as chat_leads,
  '{{' || (select string_agg('"' || source || '":' || n, ',' order by source) from (select source, count(*) as n from documents group by source)) || '}}' as source_counts,
  (select count(*) from events where event_id % 7 = 0 or event_id % 11 = 0) as errors,
  '{{' || (select string_agg('"' || event_type || '":' || n, ',' order by event_type) from (select event_type, count(*) filter (where event_id % 7 = 0 or event_id % 11 = 0) as n from events group by event_type)) || '}}' as source_errors,
  'completed' as chat_status from {_CHAT}""",
    "g6_error_counts": "select event_type, count(*) filter (where event_id % 7 = 0 or event_id % 11 = 0) as errors from events group by event_type",
    "h1_stream_score": _WEB + " select doc_id, intent_score, classification from leads",
    "h2_stream_dedup": "select distinct user_id, event_type from events",
    "h2b_stream_first_sights": """with recursive e as (select user_id, event_type, ts from events where ts < (select max(ts) from events) - interval 24 hours),
  s(user_id, event_type, ts) as (select user_id, event_type, min(ts) from e group by all
    union all select s.user_id, s.event_type, min(e.ts) from s join e on e.user_id = s.user_id and e.event_type = s.event_type and e.ts >= s.ts + interval 3 days group by s.user_id, s.event_type, s.ts)
  select user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as sight from s""",
    "h3_stream_ledger": "select distinct sha256(lower(coalesce(text, '') || '||')) as lead_id from documents",
    "h4_stream_counts": "select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, event_type, n from (select date_trunc('day', ts) as w, event_type, count(*) as n from events group by all) where w + interval 1 day <= (select max(ts) from events) - interval 24 hours",
}
