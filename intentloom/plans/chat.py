"""Queries on chat messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions import predicates as P
from intentloom.functions import scoring as S
from intentloom.functions.lexicons import PROSE_CHAT as LEX
from intentloom.functions.text import fold_text, group_blob, strip_text
from intentloom.operators import identity, leads
from intentloom.plans import bindings as B
from intentloom.plans import web

ID = ["group_id", "message_id"]
KINDS = ("buy", "weak", "sell", "rent", "context")


def scored(spark, d):
    return leads.scored_messages(B.messages(spark, d), LEX)


def _matches(kind):
    def query(spark, d):
        found = P.pattern_matches(fold_text(F.col("text")), getattr(LEX, kind))
        return B.messages(spark, d).select(*ID, F.array_join(found, ",").alias("matches"))

    return query


def d5b(spark, d):
    """Markets by votes over a table of places that grows with the documents."""
    found = B.messages(spark, d).withColumn("blob", group_blob(F.col("group"), F.col("text"))).withColumn("key", F.concat_ws("|", "group_id", "message_id"))
    return S.market_argmax_join(found, "key", "blob", web._gazetteer(spark, d), most=20).select(*ID, "market")


def e5(spark, d):
    events = B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return identity.window_cutoff(events, "ts", F.lit("2024-01-30 12:00:00").cast("timestamp")).select("event_id")


def e6(spark, d):
    """The newest 500 of each event type, and of these the ones with a value."""
    newest = identity.latest_n_per_group(B.table(spark, d, "events"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()], 500)
    return newest.where("value > 5").select("event_type", "event_id")


def e6b(spark, d):
    twice = B.messages(spark, d).unionByName(B.messages(spark, d).withColumn("text", F.concat("text", F.lit(" again"))))
    keyed = twice.withColumn("lead_id", identity.message_key("chat", F.col("group_id"), F.col("message_id")))
    return identity.first_wins_dedup(keyed, "lead_id", F.length("text")).select(*ID, "text")


def f2(spark, d):
    found = leads.chat_leads(B.messages(spark, d), LEX, B.AS_OF)
    joined = {c: F.array_join(c, ",") for c in ("buyer_matches", "context_matches", "weak_matches", "seller_matches", "rent_matches")}
    return found.withColumns(joined).withColumn("found_at", F.date_format("found_at", "yyyy-MM-dd HH:mm:ss")).withColumn("message", F.sha2("message", 256))


def f2c(spark, d):
    c = F.col
    return B.messages(spark, d).select(*ID, S.group_label(F.when(c("message_id") % 3 == 0, c("group")), F.when(c("message_id") % 3 == 1, c("group_username")), c("group_id")).alias("label"))


def f2a(spark, d):
    n = F.col("c_custkey")
    user = F.when(n % 3 == 0, F.concat(F.lit("u"), n.cast("string")))
    return B.table(spark, d, "customer").select("c_custkey", S.sender_label(user, F.when(n % 2 == 0, F.col("c_name")), F.when(n % 5 > 0, F.col("c_mktsegment"))).alias("author"))


# Fixed value in it: the pattern of chat budgets, shortened to what tells whether there is one.
_SIGNALS = f"""messages as (select conv_id as group_id, role as "group", case when role = 'user' then role else '' end as group_username, turn as message_id, coalesce({B.TEXT_SQL}, '') as text,
  {B.folded_sql(B.TEXT_SQL)} as f, {B.folded_sql(f"role || ' ' || coalesce({B.TEXT_SQL}, '')")} as g from conversations),
signals as (select *, {', '.join(f"{B.matches_sql('f', getattr(LEX, k))} as {k}" for k in KINDS)},
  regexp_matches(text, '(?i)(£|€|\\$|₺|₽)\\s?\\d|\\b\\d[\\d\\s.,]*\\s?(gbp|eur|usd|try|tl|руб|млн|million|k)\\b') as budget,
  {B.any_sql('f', LEX.negative)} as negative, case "group" when 'user' then 'HIGH' when 'system' then 'MEDIUM' else 'NORMAL' end as priority,
  {', '.join(f"{B.hits_sql('g', terms)} as v{i}" for i, (_, terms) in enumerate(LEX.gazetteer))} from messages),
asked as (select *, len(context) > 0 and (len(buy) > 0 or budget or {B.any_sql('f', LEX.nouns)}) as question,
  case when greatest(v0, v1, v2) = 0 then 'unknown' when v0 >= v1 and v0 >= v2 then '{LEX.gazetteer[0][0]}' when v1 >= v2 then '{LEX.gazetteer[1][0]}' else '{LEX.gazetteer[2][0]}' end as market from signals),
scores as (select *, cast(greatest(0, least(100, least(60, 18 * len(buy)) + least(18, 5 * len(weak)) + least(12, 4 * len(context)) + case when budget then 12 else 0 end
  + case priority when 'HIGH' then 14 when 'MEDIUM' then 7 else 0 end - least(75, 30 * len(sell)) - least(75, 35 * len(rent)) - case when negative then 50 else 0 end)) as integer) as chat_score from asked),
labelled as (select *, case when len(rent) > 0 and len(buy) = 0 and not question then 'REJECT_RENT' when len(sell) > 0 and len(buy) = 0 and not question then 'REJECT_SELLER'
  when negative then 'REJECT_STATUS' when chat_score >= 65 or (question and priority = 'HIGH' and chat_score >= 50) then 'HOT'
  when chat_score >= 35 or (question and priority in ('HIGH', 'MEDIUM') and chat_score >= 30) then 'WARM' when chat_score >= 15 then 'REVIEW' else 'LOW' end as classification from scores)"""
LABELLED_SQL = _SIGNALS


def _from(columns: str, where: str = "") -> str:
    return f"with {_SIGNALS} select {columns} from labelled {where}"


_KEY = "sha256('chat|' || group_id || '|' || message_id)"
QUERIES = {
    "b3_strip_text": lambda s, d: B.messages(s, d).select(*ID, strip_text(F.concat(F.lit(" \n\t"), "text", F.lit("\n "))).alias("stripped")),
    "b4_group_blob": lambda s, d: B.messages(s, d).select(*ID, group_blob(F.col("group"), F.col("text")).alias("blob")),
    "c7a_buy_matches": _matches("buy"),
    "c7b_weak_matches": _matches("weak"),
    "c7c_sell_matches": _matches("sell"),
    "c7d_rent_matches": _matches("rent"),
    "c7e_context_matches": _matches("context"),
    "c9_budget_chat": lambda s, d: B.messages(s, d).select(*ID, P.budget_chat(F.col("text")).alias("budget")),
    "c12_buyer_question": lambda s, d: scored(s, d).select(*ID, "buyer_question"),
    "d5_market_argmax": lambda s, d: scored(s, d).select(*ID, "market"),
    "d5b_market_argmax_join": d5b,
    "d6_chat_score": lambda s, d: scored(s, d).select(*ID, "chat_score"),
    "d7_chat_label": lambda s, d: scored(s, d).select(*ID, "classification"),
    "e2_message_key": lambda s, d: B.messages(s, d).select(*ID, identity.message_key("chat", F.col("group_id"), F.col("message_id")).alias("lead_id")),
    "e5_window_cutoff": e5,
    "e6_latest_n_per_group": e6,
    "e6b_message_dedup": e6b,
    "f2_chat_leads": f2,
    "f2a_sender_label": f2a,
    "f2b_message_link": lambda s, d: B.messages(s, d).select(*ID, S.message_link("https://chat.example/", F.col("group_username"), F.col("message_id")).alias("url")),
    "f2c_group_label": f2c,
}
SQL = {
    "b3_strip_text": f"select conv_id as group_id, turn as message_id, regexp_replace({B.TEXT_SQL}, '^\\s+|\\s+$', '', 'g') as stripped from conversations",
    "b4_group_blob": f"select conv_id as group_id, turn as message_id, {B.folded_sql("role || ' ' || " + B.TEXT_SQL)} as blob from conversations",
    "c7a_buy_matches": _from("group_id, message_id, array_to_string(buy, ',') as matches"),
    "c7b_weak_matches": _from("group_id, message_id, array_to_string(weak, ',') as matches"),
    "c7c_sell_matches": _from("group_id, message_id, array_to_string(sell, ',') as matches"),
    "c7d_rent_matches": _from("group_id, message_id, array_to_string(rent, ',') as matches"),
    "c7e_context_matches": _from("group_id, message_id, array_to_string(context, ',') as matches"),
    "c9_budget_chat": _from("group_id, message_id, budget"),
    "c12_buyer_question": _from("group_id, message_id, question as buyer_question"),
    "d5_market_argmax": _from("group_id, message_id, market"),
    "d5b_market_argmax_join": f"with {_SIGNALS}, gazetteer(market, ord, term) as ({web.GAZETTEER_SQL}), votes as (select group_id, message_id, market, ord, count(*) as n from messages join gazetteer on contains(g, term) group by all) select group_id, message_id, coalesce(arg_max(market, n * 100 - ord), 'unknown') as market from messages left join votes using (group_id, message_id) group by all",
    "d6_chat_score": _from("group_id, message_id, chat_score"),
    "d7_chat_label": _from("group_id, message_id, classification"),
    "e2_message_key": _from(f"group_id, message_id, {_KEY} as lead_id"),
    "e5_window_cutoff": "select event_id from events where ts >= timestamp '2024-01-29 12:00:00'",
    "e6_latest_n_per_group": "select event_type, event_id from (select * from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 500) where value > 5",
    "e6b_message_dedup": f"select conv_id as group_id, turn as message_id, {B.TEXT_SQL} as text from conversations",
    "f2_chat_leads": _from(
        f"""{_KEY} as lead_id, 'Chat' as source, 'joined_group' as source_type, "group", priority as group_priority, group_username, message_id,
        strftime(make_timestamp((1704067200 + group_id * 60 + message_id) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as message_time,
        case when "group" = 'user' then '@u' || group_id else trim("group" || ' ' || group_id) end as author, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as message,
        case when group_username <> '' then 'https://chat.example/' || group_username || '/' || message_id else '' end as url, market, budget as budget_detected,
        array_to_string(buy, ',') as buyer_matches, array_to_string(context, ',') as context_matches, array_to_string(weak, ',') as weak_matches,
        array_to_string(sell, ',') as seller_matches, array_to_string(rent, ',') as rent_matches, chat_score, classification, negative as negative_status, '{B.FOUND_AT}' as found_at""",
        "where classification in ('HOT', 'WARM') and text <> ''",
    ),
    "f2a_sender_label": "select c_custkey, case when c_custkey % 3 = 0 then '@u' || c_custkey else trim(case when c_custkey % 2 = 0 then c_name else '' end || ' ' || case when c_custkey % 5 > 0 then c_mktsegment else '' end) end as author from customer",
    "f2b_message_link": _from("group_id, message_id, case when group_username <> '' then 'https://chat.example/' || group_username || '/' || message_id else '' end as url"),
    "f2c_group_label": """select conv_id as group_id, turn as message_id, case when turn % 3 = 0 then role when turn % 3 = 1 and role = 'user' then 'user' else cast(conv_id as varchar) end as label from conversations""",
}
