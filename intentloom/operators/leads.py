"""Leads: scored and labelled rows, alerts and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from intentloom.functions import predicates as P
from intentloom.functions import scoring as S
from intentloom.functions.lexicons import ChatLexicon, ChatWeights, WebLexicon, WebWeights
from intentloom.functions.text import fold_text, group_blob, item_blob, strip_text
from intentloom.operators import ledger as ledgers
from intentloom.operators.identity import fingerprint, first_wins_dedup, ledger_anti_join, message_key
from intentloom.operators.summary import SKETCH

WEB_LEAD = ("source", "url", "title", "text", "published", "author", "lead_id", "market", "route_to", "intent_score", "credibility_score", "market_fit_score", "classification", "found_at")


def scored_items(items: DataFrame, lex: WebLexicon, routes: DataFrame | None = None, weights: WebWeights = WebWeights()) -> DataFrame:
    """`items` with blob, market, the three scores, classification and route_to.

    All lexicon work happens in one projection, behind a term that keeps later filters from repeating it. Routes come from
    the table `routes` (market, route_to) if there is one, else from the lexicon.
    """
    blob = F.col("blob")
    signals = items.withColumn("blob", item_blob(F.col("title"), F.col("text"))).withColumns({
        "intent_hits": P.steady(P.phrase_hits(blob, lex.intent)), "exclude_hits": P.steady(P.phrase_hits(blob, lex.exclude)),
        "budget": P.budget_web(blob), "timeframe": P.any_phrase(blob, lex.timeframe), "pronoun": P.any_phrase(blob, lex.pronoun),
        "market": S.market_first_match(blob, lex.gazetteer),
    })
    flags = [F.col(c) for c in ("budget", "timeframe", "pronoun")]
    scores = signals.withColumns({
        "intent_score": S.intent_score(F.col("intent_hits"), F.col("exclude_hits"), *flags, weights),
        "credibility_score": S.credibility_score(blob, F.col("exclude_hits"), *flags, weights),
        "market_fit_score": S.market_fit_score(F.col("market"), F.col("budget"), lex.premium, weights),
    })
    label = S.web_label(F.col("intent_score"), F.col("credibility_score"), F.col("market_fit_score"), weights)
    labelled = scores.withColumn("classification", label)
    if routes is not None:
        return S.route_lookup(labelled, routes, lex.default_route)
    return labelled.withColumn("route_to", S.route_of(F.col("market"), lex.routes, lex.default_route))


def web_leads(items: DataFrame, lex: WebLexicon, found_at: datetime, ledger: DataFrame | None = None, order: Column | None = None, gate: Column | None = None, routes: DataFrame | None = None, seen: Observation | None = None, weights: WebWeights = WebWeights()) -> DataFrame:
    """HOT and WARM items as leads: require a url, drop copies (first wins), gate, score, drop what the ledger has.

    Copies are dropped before the gates, so that a gated first copy also hides later ones. `order` is the
    arrival order (without it items are taken as distinct); `gate` a predicate on blob and published. `seen` is told the distinct items before the gates
    (unique_results, unique_sketch) while the leads are made.
    """
    kept = items.where(F.length(F.coalesce("url", F.lit(""))) > 0).withColumn("lead_id", fingerprint(F.col("url"), F.col("title"), F.col("author")))
    if order is not None:
        kept = first_wins_dedup(kept, "lead_id", order)
    if seen is not None:
        kept = kept.observe(seen, F.count(F.lit(1)).alias("unique_results"), F.hll_sketch_agg("lead_id", F.lit(SKETCH)).alias("unique_sketch"))
    kept = kept.withColumn("blob", item_blob(F.col("title"), F.col("text")))
    if gate is not None:
        kept = kept.where(gate)
    found = scored_items(kept, lex, routes, weights).where(P.label_filter(F.col("classification")))
    if ledger is not None:
        found = ledger_anti_join(found, ledger)
    extra = [c for c in items.columns if c not in WEB_LEAD]
    return found.withColumn("found_at", F.lit(found_at)).select(*WEB_LEAD, *extra)


def scored_messages(messages: DataFrame, lex: ChatLexicon, group: str = "group", text: str = "text", priorities: DataFrame | None = None, weights: ChatWeights = ChatWeights()) -> DataFrame:
    """`messages` with evidence arrays, budget, negative, priority, market, chat_score and classification.

    What is read from the text is held as one value, so that filters on the score or label don't match the patterns again. Priorities come from the
    table `priorities` (name, priority) if there is one, else from the lexicon.
    """
    c, folded = F.col, fold_text(F.col(text))
    told = P.chat_matches(c(text), lex) | {
        "budget_detected": P.budget_chat(c(text)), "negative_status": P.any_phrase(folded, lex.negative), "noun": P.any_phrase(folded, lex.nouns),
        "market": S.market_argmax(group_blob(c(group), c(text)), lex.gazetteer),
    }
    found = messages.withColumn("told_", P.held(F.struct(*[v.alias(k) for k, v in told.items()])))
    found = found.select(*messages.columns, *[c(f"told_.{k}").alias(k) for k in told])
    if priorities is not None:
        found = S.group_priority_join(found, group, priorities)
    else:
        found = found.withColumn("group_priority", S.group_priority(c(group), lex.high, lex.medium))
    question = P.buyer_question(c("noun"), c("context_matches"), c("buy_matches"), c("budget_detected"))
    found = found.withColumn("buyer_question", question).drop("noun")
    evidence = [c(f"{k}_matches") for k in ("buy", "weak", "sell", "rent", "context")]
    found = found.withColumn("chat_score", S.chat_score(*evidence, c("budget_detected"), c("negative_status"), c("group_priority"), weights))
    return found.withColumn("classification", S.chat_label(c("chat_score"), c("buy_matches"), c("sell_matches"), c("rent_matches"), c("buyer_question"), c("negative_status"), c("group_priority"), weights))


def chat_leads(messages: DataFrame, lex: ChatLexicon, found_at: datetime, tag: str = "chat", base: str = "https://chat.example/", ledger: DataFrame | None = None, priorities: DataFrame | None = None, weights: ChatWeights = ChatWeights()) -> DataFrame:
    """HOT and WARM messages as leads of 22 columns.

    messages: group_id, group, group_username, message_id, text, date, sender (username, first_name, last_name).
    Messages without text or date are dropped; one row per group and message is kept.
    """
    c = F.col
    kept = messages.where((F.length(F.coalesce("text", F.lit(""))) > 0) & c("date").isNotNull())
    kept = first_wins_dedup(kept.withColumn("lead_id", message_key(tag, c("group_id"), c("message_id"))), "lead_id", F.struct("date", "text"))
    found = scored_messages(kept, lex, priorities=priorities, weights=weights).where(P.label_filter(c("classification")))
    if ledger is not None:
        found = ledger_anti_join(found, ledger)
    return found.select(
        "lead_id", F.lit("Chat").alias("source"), F.lit("joined_group").alias("source_type"), "group", "group_priority",
        F.coalesce("group_username", F.lit("")).alias("group_username"), "message_id", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("message_time"),
        S.sender_label(c("sender.username"), c("sender.first_name"), c("sender.last_name")).alias("author"), strip_text(c("text")).alias("message"),
        S.message_link(base, c("group_username"), c("message_id")).alias("url"), "market", "budget_detected", c("buy_matches").alias("buyer_matches"), "context_matches",
        "weak_matches", c("sell_matches").alias("seller_matches"), "rent_matches", "chat_score", "classification", "negative_status", F.lit(found_at).alias("found_at"),
    )


def alert_top_k(leads: DataFrame, order: list[Column], k: int = 10) -> DataFrame:
    """The first k leads by arrival: a top-k per task and one merge, never a full sort."""
    return leads.orderBy(*order).limit(k)


def alert_message() -> Column:
    """The alert of a web lead."""
    mark = F.when(F.col("classification") == "HOT", "!!").otherwise("!")
    return F.format_string(
        "%s LEAD - %s\n\n%s\n%s | %s\n\n%s\n\nIntent: %d/100\nCredibility: %d/100\nMarket fit: %d/100\n\n%s",
        mark, "classification", *[F.coalesce(c, F.lit("")) for c in ("source", "market", "route_to", "title")], "intent_score", "credibility_score", "market_fit_score", F.coalesce("url", F.lit("")),
    )


def empty_digest(leads: DataFrame, queries: int, results: DataFrame, errors: int | Column = 0) -> DataFrame:
    """One digest row with the run's counts if there are no leads, else none. `results` has the results per source (source, n), in whose order they are told."""
    told = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("source"), "n"))), lambda r: F.concat(r["source"], F.lit(" "), r["n"].cast("string")))
    counts = results.agg(F.array_join(told, ", ").alias("results"))
    none = leads.agg(F.count("*").alias("n")).where("n = 0")
    found = none.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k")
    errors = errors if isinstance(errors, Column) else F.lit(errors)
    return found.select(F.format_string("No new leads since the last run.\n\nQueries: %d\nResults: %s\nErrors: %d", F.lit(queries), F.when(F.col("results") == "", "none").otherwise(F.col("results")), errors).alias("message"))


def lead_sink(leads: DataFrame, path: str, run_id: str, order: Column | None = None, prefix: int | None = None) -> DataFrame:
    """Appends the leads that the ledger at `path` lacks, tagged by this run; returns what the run has stored.

    Of leads with one key the first by `order`, the arrival order, stays. A run that is repeated under its id finds its keys stored and adds nothing. Only partitions of the ledger that the run's keys
    fall into are read (see ledger).
    """
    return ledgers.append(leads, path, "lead_id", order, prefix, run_id=run_id)


def scan_log_sink(summary: DataFrame, path: str) -> None:
    """Writes the run's record over any earlier one of the same scan_id."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def json_export(leads: DataFrame) -> DataFrame:
    """One JSON string per lead, fields in column order."""
    return leads.select(F.to_json(F.struct(*[F.col(c) for c in leads.columns])).alias("json"))
