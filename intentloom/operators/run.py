"""One whole run: search hits, news and chat messages to stored leads, alerts and a record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from intentloom.functions import predicates as P
from intentloom.functions.lexicons import ChatLexicon, ChatWeights, WebLexicon, WebWeights
from intentloom.operators import leads as L
from intentloom.operators import ledger, summary
from intentloom.operators.identity import arrival, latest_n_per_group, window_cutoff
from intentloom.operators.intake import bridge_query_select, domain_allow_filter, groups_only, require_fields
from intentloom.sources.feeds import RESULT_CAP


@dataclass
class Run:
    """What a run made: new web and chat leads, alert messages (or one digest), and the one-row record."""

    web: DataFrame
    chat: DataFrame
    alerts: DataFrame
    record: DataFrame


#: States of a chat pass that was not made: no access was given, there is no session, or it is not authorised.
SKIPPED = ("skipped", "skipped_no_session", "skipped_unauthorized")


def web_pass(
    search: DataFrame, news: DataFrame, lex: WebLexicon, as_of: datetime, ledger: DataFrame | None = None, routes: DataFrame | None = None, raw: Observation | None = None, seen: Observation | None = None,
    sources: Sequence[str] = (), weights: WebWeights = WebWeights(),
) -> DataFrame:
    """Leads of both sources in one plan: copies are dropped across them in arrival order, and only search hits are gated.

    While the leads are made, `raw` is told the items that each of `sources` gave, in their order (n0, n1, ...), and all (items); `seen` the distinct ones.
    """
    both = search.withColumn("source_ord", F.lit(0)).unionByName(news.withColumn("source_ord", F.lit(1)), allowMissingColumns=True)
    if raw is not None:
        both = both.observe(raw, F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("source") == s).alias(f"n{i}") for i, s in enumerate(sources)])
    order = arrival(F.col("query_idx"), F.col("source_ord"), F.col("pos"))
    gate = (F.col("source_ord") == 1) | P.quality_gate(F.col("blob"), F.col("published"), F.lit(as_of), lex)
    return L.web_leads(both, lex, as_of, ledger=ledger, order=order, gate=gate, routes=routes, seen=seen, weights=weights)


def recent_messages(
    messages: DataFrame, as_of: datetime, hours: int = 24, per_group: int = 500, groups: DataFrame | None = None, met: Observation | None = None, read: Observation | None = None
) -> DataFrame:
    """What a scan reads of each group: of its newest `per_group` messages, empty ones counted, those with text and date of the last `hours`.

    With `groups` (group_id, is_group) only messages of real groups are read. While messages are read, `met` is told the groups that have any (chat_groups),
    `read` the messages that are left (chat_messages_scanned).
    """
    if groups is not None:
        messages = messages.join(groups_only(groups).select("group_id"), "group_id", "left_semi")
    newest = latest_n_per_group(messages, "group_id", [F.col("date").desc_nulls_last(), F.col("message_id").desc()], per_group, rank="rank_")
    if met is not None:
        newest = newest.observe(met, F.count_if(F.col("rank_") == 1).alias("chat_groups"))
    recent = window_cutoff(require_fields(newest.drop("rank_"), "text", "date"), "date", F.lit(as_of), hours)
    return recent if read is None else recent.observe(read, F.count(F.lit(1)).alias("chat_messages_scanned"))


def _chat_pass(messages: DataFrame, chat: ChatLexicon, started: datetime, hours: int, per_group: int, groups: DataFrame | None, priorities: DataFrame | None, path: str, run_id: str, prefix: int | None, weights: ChatWeights) -> tuple[DataFrame, int, int]:
    """New leads, groups met and messages read, of one pass over the messages."""
    met, read = Observation(), Observation()
    recent = recent_messages(messages, started, hours, per_group, groups, met, read)
    found = L.lead_sink(L.chat_leads(recent, chat, started, priorities=priorities, weights=weights), path, run_id, F.struct("message_time", "message_id"), prefix)
    count = met.get["chat_groups"] if groups is None else groups_only(groups).count()
    return found, count, read.get["chat_messages_scanned"]


def scan(
    search: DataFrame, news: DataFrame, messages: DataFrame | None, lex: WebLexicon, chat: ChatLexicon, started: datetime, completed: datetime, queries: int, store: str, log: str, hours: int = 24, *,
    per_group: int = 500, domains: DataFrame | None = None, groups: DataFrame | None = None, priorities: DataFrame | None = None, routes: DataFrame | None = None, failures: DataFrame | None = None,
    sources: Sequence[str] | None = None, chat_skipped: str = "", results_per_query: int = RESULT_CAP, quality_gate: str = "personal_no_excluded_place_no_negative_no_listing_90d",
    prefix: int | None = None, web_weights: WebWeights = WebWeights(), chat_weights: ChatWeights = ChatWeights(),
) -> Run:
    """Runs both passes against the stores under `store` (web and chat leads) and writes the record to `log`.

    Search hits are held to the domains of their query (`domains`: query_idx, domain), news are those of bridge queries, and of each group the newest
    messages are read. Leads are appended if their key is new; a run that is repeated under its start second finds them stored under its
    own id and returns them. Alerts are the first ten new web leads in arrival order, else one digest with the results per source and the errors. `priorities` and `routes` are tables in
    place of the lexicons' lists.

    Each input is read once: what the record counts is observed while leads are made. Of `sources`, the names that items may have as source, each is
    counted so; without them a second pass groups the items by source. The record counts all groups met, messages with text and date in the window, `failures` (source, errors) of
    the sources, and keeps a sketch of the distinct results. A chat pass that fails is told by chat_status "error" and counts as an error of the source Chat, and the run goes on with the chat leads that
    were stored before. Without messages, or with one of SKIPPED as `chat_skipped`, there is no chat pass, and the state is told. `prefix` are the letters of a key that name its partition in the stores.
    """
    run_id, spark = started.strftime("%Y%m%dT%H%M%SZ"), search.sparkSession
    if chat_skipped not in ("", *SKIPPED):
        raise ValueError(f"chat_skipped must be one of {SKIPPED}")
    if domains is not None:
        search = domain_allow_filter(search, domains, by="query_idx")
    news = bridge_query_select(news, queries, "query_idx")
    raw, seen = Observation(), Observation()
    order = arrival(F.col("query_idx"), F.col("source_ord"), F.col("pos"))
    web = L.lead_sink(web_pass(search, news, lex, started, routes=routes, raw=raw, seen=seen, sources=sources or (), weights=web_weights), f"{store}/web", run_id, order, prefix)
    status, chat_errors, met, read = chat_skipped or ("completed" if messages is not None else SKIPPED[0]), 0, 0, 0
    found = spark.createDataFrame([], "lead_id string")
    if status == "completed":
        try:
            found, met, read = _chat_pass(messages, chat, started, hours, per_group, groups, priorities, f"{store}/chat", run_id, prefix, chat_weights)
        except PySparkException:
            status, chat_errors = "error", 1
            stored = ledger.read(spark, f"{store}/chat")
            if stored is not None:
                found = stored.where(F.col("run_id") == run_id).drop("prefix")
    counted = spark.createDataFrame([(met, read)], "chat_groups long, chat_messages_scanned long")
    if sources is None:
        items = search.select("source").unionByName(news.select("source"))
        by_source = summary.source_counts(items)
    else:
        by_source = spark.createDataFrame([(s, raw.get[f"n{i}"]) for i, s in enumerate(sources) if raw.get[f"n{i}"]], "source string, n long")
    unique = spark.createDataFrame([(seen.get["unique_results"], seen.get["unique_sketch"])], "unique_results long, unique_sketch binary")
    all_sources = by_source.unionByName(found.agg(F.lit("Chat").alias("source"), F.count("*").alias("n")))
    failed = by_source.select("source", F.lit(0).cast("long").alias("errors"))
    if chat_errors:
        failed = failed.unionByName(spark.createDataFrame([("Chat", chat_errors)], "source string, errors long"))
    if failures is not None:
        failed = failed.unionByName(failures.select("source", F.col("errors").cast("long").alias("errors")))
    record = summary.scan_summary(
        started, completed, queries, status, results_per_query, quality_gate, unique=unique, new=summary.new_lead_counts(web), failed=summary.failure_counts(failed), chat=counted,
        chat_new=found.agg(F.count("*").alias("chat_new_hot_warm")), sources=summary.counts_map(all_sources.withColumnRenamed("n", "source_counts"), "source", "source_counts"),
    )
    row = record.first()
    record = spark.createDataFrame([row], record.schema)  # one row, made once; its maps with keys in order again
    record = record.withColumns({c: F.map_from_entries(F.array_sort(F.map_entries(c))) for c in ("source_counts", "source_errors")})
    L.scan_log_sink(record, log)
    first = L.alert_top_k(web, [F.ceil(F.col("query_idx") / 10), "source_ord", "query_idx", "pos"])
    alerts = first.select(L.alert_message().alias("message")).unionByName(L.empty_digest(web, queries, by_source, F.lit(row["errors"])))
    return Run(web, found, alerts, record)
