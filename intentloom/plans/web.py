"""Queries on web items."""

from __future__ import annotations

from pyspark.sql import functions as F

from intentloom.functions import predicates as P
from intentloom.functions import scoring as S
from intentloom.functions.lexicons import PROSE_WEB as LEX
from intentloom.functions.markup import NAMES, element_text
from intentloom.functions.text import epoch_normalise, fold_text, item_blob
from intentloom.operators import identity, leads, summary
from intentloom.plans import bindings as B

def _blob():
    return F.col("blob")


def _blobs(spark, d):
    return B.items(spark, d).withColumn("blob", item_blob(F.col("title"), F.col("text")))


def _flag(predicate, name):
    return lambda spark, d: _blobs(spark, d).select("doc_id", predicate().alias(name))


_ITEMS = f"with {B.ITEMS_SQL} "
# Fixed value: the pattern of web budgets, as DuckDB writes it.
_BUDGET = r"regexp_matches(blob, '[$€£₺]\s?[\d,.]+|\b\d{2,3}\s?[kKmM]\b|\b\d{4,}\b')"
_SIGNALS = f"""{B.ITEMS_SQL}, signals as (select *, {B.hits_sql('blob', LEX.intent)} as ih, {B.hits_sql('blob', LEX.exclude)} as xh,
  cast({_BUDGET} as integer) as b, cast({B.any_sql('blob', LEX.timeframe)} as integer) as t, cast({B.any_sql('blob', LEX.pronoun)} as integer) as p,
  {B.market_sql('blob', LEX.gazetteer)} as market from items),
scores as (select *, cast(least(100, 35 + 7 * ih + 12 * b + 10 * t + 8 * p - 20 * xh) as integer) as intent_score,
  cast(least(100, 55 + 12 * b + 10 * t + case when length(blob) > 450 then 10 else 0 end + 8 * p - 25 * xh) as integer) as credibility_score,
  cast(greatest(0, least(100, case when market <> 'unknown' then 55 else 35 end + 12 * b + case when market in ({', '.join(map(B.quoted, LEX.premium))}) then 8 else 0 end)) as integer) as market_fit_score
  from signals),
labelled as (select *, case when intent_score >= 82 and credibility_score >= 75 and market_fit_score >= 60 then 'HOT'
  when intent_score >= 62 and credibility_score >= 65 and market_fit_score >= 45 then 'WARM' else 'REVIEW' end as classification,
  case {' '.join(f"when market = {B.quoted(m)} then {B.quoted(r)}" for m, r in LEX.routes)} else {B.quoted(LEX.default_route)} end as route_to,
  sha256(lower(url || '|' || title || '|' || author)) as lead_id from scores)"""
LABELLED_SQL = _SIGNALS
_GATE = f"""{B.any_sql('blob', LEX.personal)} and not {B.any_sql('blob', LEX.excluded_places)} and not {B.any_sql('blob', LEX.negative)} and {B.hits_sql('blob', LEX.listing)} < 2"""


def _scored(spark, d):
    return leads.scored_items(B.items(spark, d), LEX)


def all_leads(spark, d, seen=None):
    """HOT and WARM leads of all documents, in arrival order; `seen`, if given, observes the distinct ones."""
    order = identity.arrival(F.col("query_idx"), F.lit(0), F.col("pos"))
    return leads.web_leads(B.items(spark, d), LEX, B.AS_OF, order=order, seen=seen)


def f1_web_leads(spark, d):
    """End to end: items to scored, labelled and routed leads."""
    found_at = F.date_format("found_at", "yyyy-MM-dd HH:mm:ss").alias("found_at")
    return all_leads(spark, d).select("doc_id", "source", "url", "lead_id", "market", "route_to", "intent_score", "credibility_score", "market_fit_score", "classification", found_at)


def gated_leads(spark, d):
    """The search pass: first wins on the text, then the gates, then scores."""
    found = B.items(spark, d).withColumn("url", F.col("text"))
    order = identity.arrival(F.col("query_idx"), F.lit(0), F.col("pos"))
    return leads.web_leads(found, LEX, B.AS_OF, order=order, gate=P.quality_gate(_blob(), F.col("published"), F.lit(B.AS_OF), LEX)).select("doc_id", "lead_id", "market", "classification")


def c1b(spark, d):
    phrases = spark.createDataFrame([(p,) for p in LEX.intent], "phrase string")
    return P.phrase_hits_join(_blobs(spark, d), "doc_id", "blob", phrases)


def _word_lexicon(spark, d):
    """The first two words of every document, lower-cased, and the lexicon's phrases: a table of phrases that grows with the documents."""
    own = spark.createDataFrame([(p,) for p in (*LEX.intent, "", *LEX.intent[:2])], "phrase string")
    return B.table(spark, d, "documents").select(F.lower(F.regexp_extract("text", "^[A-Za-z]+ [a-z]+", 0)).alias("phrase")).where("phrase <> ''").unionByName(own)


def c1c(spark, d):
    """A lexicon beyond the bound of the array: matched by grams."""
    return P.phrase_hits_join(_blobs(spark, d), "doc_id", "blob", _word_lexicon(spark, d), most=20)


def _gazetteer(spark, d):
    """Places from documents, ten markets by turns, behind those of the lexicon."""
    own = spark.createDataFrame([(m, i, t) for i, (m, terms) in enumerate(LEX.gazetteer) for t in terms], "market string, market_ord int, term string")
    word = F.lower(F.regexp_extract("text", "^[A-Za-z]+ [a-z]+", 0))
    made = B.table(spark, d, "documents").where("doc_id % 4 = 0").select(F.concat(F.lit("m"), (F.col("doc_id") % 10).cast("string")).alias("market"), (F.col("doc_id") % 10 + 3).cast("int").alias("market_ord"), word.alias("term"))
    return made.where("term <> ''").unionByName(own)


def d1b(spark, d):
    return S.market_first_match_join(_blobs(spark, d), "doc_id", "blob", _gazetteer(spark, d), most=20).select("doc_id", "market")


def c6(spark, d):
    events = B.table(spark, d, "events")
    published = F.when(F.col("event_id") % 10 == 0, "garbage").when(F.col("event_id") % 10 == 1, "").when(F.col("event_id") % 10 == 2, F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    published = published.when(F.col("event_id") % 10 == 3, F.concat(F.date_format("ts", "yyyy"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"), F.lit("-"), (F.weekday("ts") + 1).cast("string")))
    published = published.when(F.col("event_id") % 10 == 4, F.concat(F.date_format(F.col("ts") + F.expr("interval 150 minutes"), "yyyy-MM-dd HH:mm:ss"), F.lit("+02:30"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return events.select("event_id", P.recency_gate(published, F.lit("2024-04-05 12:00:00").cast("timestamp")).alias("keep"))


def d4(spark, d):
    routes = spark.createDataFrame([*LEX.routes], "market string, route_to string")
    marked = _blobs(spark, d).select("doc_id", S.market_first_match(_blob(), LEX.gazetteer).alias("market"))
    return S.route_lookup(marked, routes, LEX.default_route)


def d3(spark, d):
    groups = B.table(spark, d, "documents").select("source").distinct()
    names = spark.createDataFrame([("SRC1", "HIGH"), ("Src2", "MEDIUM"), ("src3", "MEDIUM")], "name string, priority string")
    return S.group_priority_join(groups, "source", names)


def e3(spark, d):
    found = B.items(spark, d).withColumn("lead_id", identity.fingerprint(F.col("text"), F.col("title"), F.col("author")))
    return identity.first_wins_dedup(found, "lead_id", identity.arrival(F.col("query_idx"), F.lit(0), F.col("pos"))).select("doc_id", "lead_id")


def e4(spark, d):
    found = B.items(spark, d).withColumn("lead_id", identity.fingerprint(F.col("text"), F.col("title"), F.col("author")))
    return identity.ledger_anti_join(found.where("doc_id % 2 = 1"), found.where("doc_id % 2 = 0")).select("doc_id", "lead_id")


def e7(spark, d):
    groups = B.table(spark, d, "documents").select(F.col("source").alias("name")).distinct().withColumn("username", F.lit(None).cast("string"))
    return identity.group_order(groups, "name", "username", ("src3", "SRC11"), ("src5",)).select("name", "priority_rank", "folded_name")


def f3(spark, d):
    return leads.alert_top_k(all_leads(spark, d), [F.ceil(F.col("query_idx") / 10), F.col("query_idx"), F.col("pos")]).select("doc_id", "lead_id", "classification")


def f4(spark, d):
    return all_leads(spark, d).select("doc_id", leads.alert_message().alias("message"))


def f4b(spark, d):
    none = all_leads(spark, d).where("intent_score > 100")
    return leads.empty_digest(none, 33, summary.source_counts(B.items(spark, d)), 3)


def f7(spark, d):
    return leads.json_export(all_leads(spark, d).select("doc_id", "lead_id", "market", "intent_score", "classification"))


QUERIES = {
    "a9_element_text": lambda s, d: B.table(s, d, "pages").select("page_id", element_text(F.col("html")).alias("text")),
    "b1_item_blob": lambda s, d: _blobs(s, d).select("doc_id", "blob"),
    "b2_fold_text": lambda s, d: B.table(s, d, "documents").select("doc_id", fold_text(F.col("text")).alias("folded")),
    "b5_epoch_normalise": lambda s, d: B.table(s, d, "events").select("event_id", F.date_format(epoch_normalise(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("utc")),
    "c1_phrase_hits": _flag(lambda: P.phrase_hits(_blob(), LEX.intent), "hits"),
    "c1b_phrase_hits_join": c1b,
    "c1c_phrase_hits_grams": c1c,
    "c2_listing_gate": _flag(lambda: P.listing_gate(_blob(), LEX.listing), "listing"),
    "c3_personal_gate": _flag(lambda: P.personal_gate(_blob(), LEX.personal), "personal"),
    "c4_negative_gate": _flag(lambda: P.negative_gate(_blob(), LEX.negative), "negative"),
    "c5_excluded_market_gate": _flag(lambda: P.excluded_market_gate(_blob(), LEX.excluded_places), "excluded"),
    "c6_recency_gate": c6,
    "c8_budget_web": _flag(lambda: P.budget_web(_blob()), "budget"),
    "c10_timeframe_flag": _flag(lambda: P.timeframe_flag(_blob(), LEX.timeframe), "timeframe"),
    "c11_pronoun_flag": _flag(lambda: P.pronoun_flag(_blob(), LEX.pronoun), "pronoun"),
    "c13_quality_gate": lambda s, d: _blobs(s, d).where(P.quality_gate(_blob(), F.col("published"), F.lit(B.AS_OF), LEX)).select("doc_id"),
    "c14_label_filter": lambda s, d: _scored(s, d).where(P.label_filter(F.col("classification"))).select("doc_id", "classification"),
    "d1_market_first_match": _flag(lambda: S.market_first_match(_blob(), LEX.gazetteer), "market"),
    "d1b_market_first_match_join": d1b,
    "d2_web_scores": lambda s, d: _scored(s, d).select("doc_id", "intent_score", "credibility_score", "market_fit_score"),
    "d2b_web_label": lambda s, d: _scored(s, d).select("doc_id", "classification"),
    "d3_group_priority": d3,
    "d4_route_lookup": d4,
    "e1_fingerprint": lambda s, d: B.table(s, d, "pages").select("page_id", identity.fingerprint(F.col("url"), F.lit(None), F.lit("A")).alias("lead_id")),
    "e3_first_wins_dedup": e3,
    "e4_ledger_anti_join": e4,
    "e7_group_order": e7,
    "f1_web_leads": f1_web_leads,
    "f1b_gated_leads": gated_leads,
    "f3_alert_top_k": f3,
    "f4_alert_message": f4,
    "f4b_empty_digest": f4b,
    "f7_json_export": f7,
}
_FIRST = "row_number() over (partition by {key} order by ceil(query_idx / 10.0), query_idx, pos) = 1"


_FIRST_WORDS = "lower(regexp_extract(text, '^[A-Za-z]+ [a-z]+', 0))"
_LEXICON_SQL = f"select {_FIRST_WORDS} as phrase from documents where {_FIRST_WORDS} <> '' union all select unnest([{', '.join(map(B.quoted, (*LEX.intent, '', *LEX.intent[:2])))}])"
GAZETTEER_SQL = f"""select 'm' || doc_id % 10, doc_id % 10 + 3, {_FIRST_WORDS} from documents where doc_id % 4 = 0 and {_FIRST_WORDS} <> ''
  union all values {', '.join(f"({B.quoted(m)}, {i}, {B.quoted(t)})" for i, (m, terms) in enumerate(LEX.gazetteer) for t in terms)}"""


def _leads(columns: str) -> str:
    return f"with {LABELLED_SQL} select {columns} from labelled where classification in ('HOT', 'WARM')"


def _element_text_sql() -> str:
    """Tags go one kind after the other; references are tokens of their own that meet the table of names by a join."""
    names = ", ".join(f"({B.quoted(n)}, {B.quoted(c)})" for n, c in NAMES.items())
    return rf"""with names(name, c) as (values {names}),
plain as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs') as t from pages),
cut as (select page_id, unnest(regexp_extract_all(t, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;|&|[^&]+')) as tok, generate_subscripts(regexp_extract_all(t, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;|&|[^&]+'), 1) as i from plain),
read as (select page_id, i, case when tok like '&#x%' or tok like '&#X%' then chr(cast('0x' || regexp_extract(tok, '[0-9a-fA-F]+', 0) as integer)) when tok like '&#%' then chr(cast(regexp_extract(tok, '[0-9]+', 0) as integer))
  else coalesce(c, tok) end as tok from cut left join names on tok = '&' || name)
select page_id, trim(regexp_replace(coalesce(string_agg(tok, '' order by i), ''), '\s+', ' ', 'g')) as text from plain left join read using (page_id) group by page_id"""


SQL = {
    "a9_element_text": _element_text_sql(),
    "b1_item_blob": _ITEMS + "select doc_id, blob from items",
    "b2_fold_text": f"select doc_id, {B.folded_sql('text')} as folded from documents",
    "b5_epoch_normalise": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as utc from events",
    "c1_phrase_hits": _ITEMS + f"select doc_id, cast({B.hits_sql('blob', LEX.intent)} as integer) as hits from items",
    "c1b_phrase_hits_join": _ITEMS + f", lexicon(phrase) as (values {', '.join(f'({B.quoted(p)})' for p in LEX.intent)}) select doc_id, cast(count(phrase) as integer) as hits from items left join lexicon on contains(blob, phrase) group by doc_id",
    "c1c_phrase_hits_grams": _ITEMS + f", lexicon(phrase) as ({_LEXICON_SQL}) select doc_id, cast(count(phrase) as integer) as hits from items left join lexicon on contains(blob, phrase) group by doc_id",
    "c2_listing_gate": _ITEMS + f"select doc_id, {B.hits_sql('blob', LEX.listing)} >= 2 as listing from items",
    "c3_personal_gate": _ITEMS + f"select doc_id, {B.any_sql('blob', LEX.personal)} as personal from items",
    "c4_negative_gate": _ITEMS + f"select doc_id, {B.any_sql('blob', LEX.negative)} as negative from items",
    "c5_excluded_market_gate": _ITEMS + f"select doc_id, {B.any_sql('blob', LEX.excluded_places)} as excluded from items",
    "c6_recency_gate": "select event_id, event_id % 10 < 2 or date_trunc(case when event_id % 10 = 3 then 'day' else 'second' end, ts) >= timestamp '2024-01-06 12:00:00' as keep from events",
    "c8_budget_web": _ITEMS + f"select doc_id, {_BUDGET} as budget from items",
    "c10_timeframe_flag": _ITEMS + f"select doc_id, {B.any_sql('blob', LEX.timeframe)} as timeframe from items",
    "c11_pronoun_flag": _ITEMS + f"select doc_id, {B.any_sql('blob', LEX.pronoun)} as pronoun from items",
    "c13_quality_gate": _ITEMS + f"select doc_id from items where {_GATE}",
    "c14_label_filter": _leads("doc_id, classification"),
    "d1_market_first_match": _ITEMS + f"select doc_id, {B.market_sql('blob', LEX.gazetteer)} as market from items",
    "d1b_market_first_match_join": _ITEMS + f", gazetteer(market, ord, term) as ({GAZETTEER_SQL}) select doc_id, coalesce(arg_min(market, ord), 'unknown') as market from items left join gazetteer on contains(blob, term) group by doc_id",
    "d2_web_scores": f"with {LABELLED_SQL} select doc_id, intent_score, credibility_score, market_fit_score from labelled",
    "d2b_web_label": f"with {LABELLED_SQL} select doc_id, classification from labelled",
    "d3_group_priority": "select distinct source, case when lower(source) = 'src1' then 'HIGH' when lower(source) in ('src2', 'src3') then 'MEDIUM' else 'NORMAL' end as group_priority from documents",
    "d4_route_lookup": f"with {LABELLED_SQL} select doc_id, market, route_to from labelled",
    "e1_fingerprint": "select page_id, sha256(lower(url || '||a')) as lead_id from pages",
    "e3_first_wins_dedup": _ITEMS + f"select doc_id, lead_id from (select *, sha256(lower(coalesce(text, '') || '||')) as lead_id from items) qualify {_FIRST.format(key='lead_id')}",
    "e4_ledger_anti_join": "with k as (select doc_id, sha256(lower(coalesce(text, '') || '||')) as lead_id from documents) select doc_id, lead_id from k where doc_id % 2 = 1 and lead_id not in (select lead_id from k where doc_id % 2 = 0)",
    "e7_group_order": "select distinct source as name, cast(case when lower(source) in ('src3', 'src11') then 0 when lower(source) = 'src5' then 1 else 2 end as integer) as priority_rank, lower(source) as folded_name from documents",
    "f1_web_leads": _leads(f"doc_id, source, url, lead_id, market, route_to, intent_score, credibility_score, market_fit_score, classification, '{B.FOUND_AT}' as found_at"),
    "f1b_gated_leads": f"with {LABELLED_SQL}, firsts as (select *, sha256(lower(text || '||')) as key from labelled where text <> '' qualify {_FIRST.format(key='sha256(lower(text))')}) select doc_id, key as lead_id, market, classification from firsts where {_GATE} and classification in ('HOT', 'WARM')",
    "f3_alert_top_k": _leads("doc_id, lead_id, classification") + " order by ceil(query_idx / 10.0), query_idx, pos limit 10",
    "f4_alert_message": _leads("doc_id, case when classification = 'HOT' then '!!' else '!' end || ' LEAD - ' || classification || chr(10) || chr(10) || source || chr(10) || market || ' | ' || route_to || chr(10) || chr(10) || title || chr(10) || chr(10) || 'Intent: ' || intent_score || '/100' || chr(10) || 'Credibility: ' || credibility_score || '/100' || chr(10) || 'Market fit: ' || market_fit_score || '/100' || chr(10) || chr(10) || url as message"),
    "f4b_empty_digest": "select 'No new leads since the last run.' || chr(10) || chr(10) || 'Queries: 33' || chr(10) || 'Results: ' || string_agg(source || ' ' || n, ', ' order by source) || chr(10) || 'Errors: 3' as message from (select source, count(*) as n from documents group by source)",
    "f7_json_export": _leads("'{\"doc_id\":' || doc_id || ',\"lead_id\":\"' || lead_id || '\",\"market\":\"' || market || '\",\"intent_score\":' || intent_score || ',\"classification\":\"' || classification || '\"}' as json"),
}
