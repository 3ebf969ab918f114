"""Rules worked out by hand on small tables."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.functions import predicates as P
from intentloom.functions import scoring as S
from intentloom.functions.lexicons import PROSE_CHAT, ChatLexicon, ChatWeights, Pattern, WebLexicon, WebWeights, words
from intentloom.functions.text import fold_text, item_blob, strip_text
from intentloom.operators import identity, intake, leads, ledger, run, summary
from intentloom.schemas import ITEMS
from intentloom.sources import feeds
from intentloom.streaming import streams

LEX = WebLexicon(
    intent=("want to buy",), exclude=("for sale",), timeframe=("2026", "month"), pronoun=("i ",),
    gazetteer=(("first", ("shared", "alpha")), ("second", ("shared", "beta"))), premium=("second",), routes=(("second", "Desk"),),
)
NOW = datetime(2026, 1, 31)


def items(spark, *texts, **more):
    rows = [{"source": "s", "url": f"u{i}", "title": None, "text": t, "published": None, "author": None, "query_idx": 1, "pos": i} | more for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ITEMS)


def one(frame):
    return frame.collect()[0]


def value(spark, column, **row):
    return one(spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).select(column.alias("v"))).v


def test_nulls_give_a_blank_blob_and_review(spark):
    r = one(leads.scored_items(items(spark, None), LEX))
    assert (r.blob, r.market, r.market_fit_score, r.classification, r.route_to) == (" ", "unknown", 35, "REVIEW", "Direct Review")


def test_length_bonus_starts_at_451(spark):
    a, b = (r.credibility_score for r in leads.scored_items(items(spark, "x" * 449, "x" * 450), LEX).orderBy("pos").collect())
    assert (a, b) == (55, 65)


def test_year_is_budget_and_timeframe(spark):
    r = one(leads.scored_items(items(spark, "2026"), LEX))
    assert r.budget and r.timeframe


def test_pronoun_needs_its_space(spark):
    assert [r.pronoun for r in leads.scored_items(items(spark, "hi there", "hit"), LEX).orderBy("pos").collect()] == [True, False]


def test_shared_place_goes_to_the_earlier_market(spark):
    assert one(leads.scored_items(items(spark, "in shared beta"), LEX)).market == "first"


def test_scores_have_no_floor(spark):
    lex = WebLexicon(intent=(), exclude=("a", "b", "c", "d", "e", "f"), gazetteer=LEX.gazetteer)
    r = one(leads.scored_items(items(spark, "abcdef"), lex))
    assert (r.intent_score, r.credibility_score) == (-85, -95)


@pytest.mark.parametrize(("text", "most"), [("for sale i want to buy 2026 alpha " + "y" * 460, "WARM"), ("i want to buy 2026 alpha " + "y" * 460, "HOT")])
def test_one_exclude_hit_is_never_hot(spark, text, most):
    lex = WebLexicon(intent=("want to buy", "buy", "to buy", "want"), exclude=("for sale",), timeframe=("2026",), pronoun=("i ",), gazetteer=LEX.gazetteer)
    assert one(leads.scored_items(items(spark, text), lex)).classification == most


def test_recency(spark):
    as_of = F.lit("2026-01-31 00:00:00").cast("timestamp")
    keep = lambda p: value(spark, P.recency_gate(F.col("p"), as_of), p=p)
    assert [keep(p) for p in ("", None, "garbage", "Mon, 01 Jan 2024 00:00:00 GMT", "2025-11-02T00:00:00Z", "2025-11-01T23:59:59Z", "2026", "10:00")] == [True, True, True, True, True, False, True, True]


def test_fold_equals_casefold(spark):
    """Every letter of Unicode, alone and between others; lower case of the dotted capital I keeps its dot as Python's does."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 512]) for i in range(0, len(every), 512)] + ["Straße", "ΣΑΣ", "ſale", "ﬁnance", "ÉCOLE", "Купить", "ÖẞŒ", "plain ASCII", "ŉ ǰ ΐ"]
    parts = spark.createDataFrame([(i, c) for i, t in enumerate(texts) for c in ([t] if i >= len(texts) - 9 else [t[j : j + 8] for j in range(0, len(t), 8)])], "i int, t string")
    wrong = [(r.t, r.f) for r in parts.select("t", fold_text(F.col("t")).alias("f")).collect() if r.f != r.t.casefold()]
    assert wrong == []


def test_fingerprint_ignores_case(spark):
    key = lambda u, t, a: value(spark, identity.fingerprint(F.col("u"), F.col("t"), F.col("a")), u=u, t=t, a=a)
    assert key("U", "T", "A") == key("u", "t", "a") != key("u", "t", "b")
    assert key(None, None, None) == key("", "", "")


def test_dedup_comes_before_gates(spark):
    rows = items(spark, "bad", "good i want to buy", url="same")
    found = leads.web_leads(rows, LEX, NOW, order=identity.arrival(F.col("query_idx"), F.lit(0), F.col("pos")), gate=F.contains("blob", F.lit("good")))
    assert found.count() == 0


def test_arrival_puts_bridge_news_after_query_ten(spark):
    rows = spark.createDataFrame([("news", 1, 7, 0), ("search", 0, 10, 0), ("search", 0, 11, 0)], "source string, ord int, query_idx int, pos int").withColumn("k", F.lit("x"))
    first = lambda r: one(identity.first_wins_dedup(r, "k", identity.arrival(F.col("query_idx"), F.col("ord"), F.col("pos"))))
    assert first(rows).source == "search" and first(rows).query_idx == 10


def test_patterns_repeat_and_keep_order(spark):
    found = value(spark, P.pattern_matches(F.col("t"), (*words("b", "a"), Pattern(r"\bA\b"), Pattern("zz"))), t="a b")
    assert found == ["b", "a", "a"]


def messages(spark, *texts):
    schema = "group_id long, `group` string, group_username string, message_id long, text string, date timestamp, sender struct<username:string,first_name:string,last_name:string>"
    return spark.createDataFrame([(1, "Club", "club", i, t, NOW, (None, "Ann", None)) for i, t in enumerate(texts)], schema)


CHAT = ChatLexicon(buy=words("buy"), sell=words("sell"), rent=words("rent"), context=words("where"), weak=(), negative=("gone",), nouns=("villa",), gazetteer=LEX.gazetteer, high=("CLUB",))


def test_chat_labels(spark):
    texts = ["rent buy", "rent", "rent gone", "sell", "buy gone", "where villa", "buy buy where 200k", "hello", "alpha beta"]
    rows = leads.scored_messages(messages(spark, *texts), CHAT).orderBy("message_id").collect()
    assert [r.classification for r in rows] == ["LOW", "REJECT_RENT", "REJECT_RENT", "REJECT_SELLER", "REJECT_STATUS", "REVIEW", "WARM", "LOW", "LOW"]
    assert all(0 <= r.chat_score <= 100 for r in rows) and rows[0].group_priority == "HIGH"
    assert rows[-1].market == "first"  # a tie goes to the earlier market


def test_chat_lead_columns(spark):
    r = one(leads.chat_leads(messages(spark, " buy where 200k ", ""), CHAT, NOW))
    assert (r.author, r.message, r.url, r.message_time) == ("Ann", "buy where 200k", "https://chat.example/club/0", "2026-01-31T00:00:00+00:00")
    assert len(r) == 22


def test_latest_counts_empty_messages(spark):
    rows = spark.createDataFrame([(1, i, "" if i >= 400 else "x") for i in range(501)], "g int, i int, t string")
    newest = identity.latest_n_per_group(rows, "g", [F.col("i").desc()], 500)
    assert newest.count() == 500 and newest.where("t <> ''").count() == 399


def test_window_bound_is_kept(spark):
    rows = spark.createDataFrame([(datetime(2026, 1, 30),), (datetime(2026, 1, 29, 23, 59, 59),)], "ts timestamp")
    assert identity.window_cutoff(rows, "ts", F.lit(NOW)).count() == 1


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://a"/><title> T </title></entry><entry><title>x &amp; y</title><author><name>N</name></author></entry></feed>'
    rows = feeds.feed_atom_items(spark.createDataFrame([(1, atom), (2, None)], "query_idx int, xml string")).orderBy("pos").collect()
    assert [(r.url, r.title, r.text, r.author) for r in rows] == [("http://a", "T", "", ""), ("", "x & y", "", "N")]
    reply = '{"results": [' + ",".join('{"url": "u%d"}' % i for i in range(7)) + "]}"
    rows = feeds.json_result_items(spark.createDataFrame([(1, reply), (2, "{broken")], "query_idx int, json string")).collect()
    assert [r.url for r in rows] == [f"u{i}" for i in range(5)] and rows[0].published == ""


def test_domains(spark):
    pages = spark.createDataFrame([("http://a.example/x",), ("http://b.a.example/",), ("http://ba.example/",), ("nonsense",), (None,)], "url string")
    found = intake.domain_allow_filter(pages, spark.createDataFrame([("A.example",), ("a.example",)], "domain string"))
    assert sorted(r.url for r in found.collect()) == ["http://a.example/x", "http://b.a.example/"]
    assert pages.where(intake.domain_allowed(F.col("url"), ["a.example"])).count() == 2
    hits = spark.createDataFrame([(1, "http://a.example/1"), (1, "http://b.example/"), (2, "http://b.example/"), (3, "http://c.example/"), (3, None), (1, "http://a.example/1")], "query_idx int, url string")
    allowed = spark.createDataFrame([(1, "a.example"), (2, "a.example"), (2, "b.example"), (3, None)], "query_idx int, domain string")
    assert sorted((r.query_idx, r.url or "") for r in intake.domain_allow_filter(hits, allowed, by="query_idx").collect()) == [(1, "http://a.example/1"), (1, "http://a.example/1"), (2, "http://b.example/"), (3, ""), (3, "http://c.example/")]


def test_lexicons_beyond_the_array(spark):
    phrases = ["", "a", "the ", "the cat", "cat", "cat", None, "straße nach", "zz", "eee", "ee", "\U0001f600x"]
    texts = ["the cat sat", "THE CAT".lower(), "", None, "straße nach", "eeee", "aa", "a\U0001f600xy"]
    keys = [None, *range(1, len(texts))]  # one key is null
    rows, lexicon = spark.createDataFrame(list(zip(keys, texts, strict=True)), "k int, t string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = {k: sum(p in t for p in phrases if p is not None) if t is not None else 0 for k, t in zip(keys, texts, strict=True)}
    for most in (100, 3):
        assert {r.k: r.hits for r in P.phrase_hits_join(rows, "k", "t", lexicon, most).collect()} == want
    none = spark.createDataFrame([], "phrase string")
    assert {r.hits for r in P.phrase_hits_join(rows, "k", "t", none).collect()} == {0}


def test_few_grams_are_sent(spark):
    """Of texts without a phrase next to nothing leaves the task, whatever the size of the lexicon."""
    lexicon = spark.range(30_000).select(F.concat(F.lit("phrase "), F.hex("id")).alias("phrase"))
    chosen = P.chosen_grams(lexicon)
    texts = spark.range(2_000).select(F.col("id").alias("key_"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") % 50 == 0, F.concat(F.lit("phrase "), F.hex(F.col("id"))))).alias("blob_"))
    grams = texts.agg(F.sum(F.length("blob_") - 4)).first()[0]
    assert P.sent_grams(texts, chosen).count() < 0.01 * grams
    found = P.phrase_matches(texts.withColumnsRenamed({"key_": "k", "blob_": "t"}), "k", "t", lexicon, 10)
    assert {r.key_ for r in found.where("phrase like 'phrase %'").collect()} == set(range(0, 2_000, 50))


@pytest.mark.parametrize("most", [100, 2])
def test_gazetteer_tables_equal_lists(spark, most):
    lists = (("first", ("shared", "Alpha", "alpha", "alpha")), ("second", ("shared", "beta", "gamma")), ("third", ("",)))
    texts = ["in shared beta", "beta gamma shared", "Alpha", "alpha", "nothing", "", None]
    rows = spark.createDataFrame([(None if i == 2 else i, t, "old") for i, t in enumerate(texts)], "k int, t string, market string")
    for gazetteer in (lists, lists[:2]):
        table = spark.createDataFrame([(m, i, t) for i, (m, terms) in enumerate(gazetteer) for t in (*terms, None)], "market string, market_ord int, term string")
        for by_list, by_table in ((S.market_first_match, S.market_first_match_join), (S.market_argmax, S.market_argmax_join)):
            want = {r.k: r.market for r in rows.select("k", by_list(F.coalesce("t", F.lit("\0")), gazetteer if by_list is S.market_argmax else gazetteer).alias("market")).where("k < 6 or k is null").collect()}
            got = {r.k: r.market for r in by_table(rows, "k", "t", table, most).collect()}
            assert {k: v for k, v in got.items() if k != 6} == want and got[6] == "unknown"


def test_bridge_queries(spark):
    rows = spark.range(1, 34).withColumnRenamed("id", "pos")
    assert [r.pos for r in intake.bridge_query_select(rows, 33).orderBy("pos").collect()] == [7, 8, 9, 10, 17, 18, 19, 20, 27, 28, 29, 30]


def test_sinks_run_again_add_nothing(spark, tmp_path):
    found = spark.createDataFrame([("a",), ("b",), ("a",)], "lead_id string")
    path = str(tmp_path / "store")
    assert leads.lead_sink(found, path, "r1").count() == 2
    assert leads.lead_sink(found, path, "r2").count() == 0
    assert leads.lead_sink(found, path, "r1").count() == 2 and spark.read.parquet(path).count() == 2


def test_digest_only_without_leads(spark):
    some, none = spark.range(2), spark.range(0)
    counts = spark.createDataFrame([("news", 2), ("hits", 5), (None, 1)], "source string, n long")
    assert leads.empty_digest(some, 3, counts).count() == 0
    assert one(leads.empty_digest(none, 3, counts, 4)).message.split("\n\n")[1] == "Queries: 3\nResults:  1, hits 5, news 2\nErrors: 4"
    assert "Results: none" in one(leads.empty_digest(none, 3, counts.limit(0))).message


def test_priority_by_table_and_list(spark):
    groups = spark.createDataFrame([("Klub",), ("KLUB",), (None,), ("x",)], "name string")
    table = spark.createDataFrame([("klub", "HIGH"), ("klub", "MEDIUM")], "name string, priority string")
    assert [r.group_priority for r in S.group_priority_join(groups, "name", table).orderBy("name").collect()] == ["NORMAL", "HIGH", "HIGH", "NORMAL"]


def test_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), (None, 2)], "source string, v int")
    counts = summary.counts_map(summary.source_counts(rows), "source", "n")
    assert one(counts).n == {"": 1, "a": 2}
    assert {r.source: r.errors for r in summary.error_counts(rows, "source", F.col("v").isNull()).collect()} == {"a": 1, None: 0}


def test_stream_in_batches_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(f"k{i % 7}",) for i in range(40)], "lead_id string").repartition(4).write.parquet(source)
    raw = streams.read_files(spark, source, files_per_trigger=1)
    streams.stream_ledger(raw, str(tmp_path / "ledger"), str(tmp_path / "ck"))
    assert sorted(r.lead_id for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [f"k{i}" for i in range(7)]


def test_plans(spark):
    """Per-group caps cut before the shuffle; filters don't evaluate lexicons twice."""
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    capped = plan(intake.cap_per_source(spark.range(100).withColumn("s", F.col("id") % 3), "s", "id", 5))
    assert capped.count("WindowGroupLimit") == 2
    scored = leads.scored_items(items(spark, "a"), LEX).where("intent_hits > 0")
    assert plan(scored).count("want to buy") == 1
    found = leads.chat_leads(messages(spark, "a"), PROSE_CHAT, NOW)
    patterns = sum(len(getattr(PROSE_CHAT, k)) for k in ("buy", "weak", "sell", "rent", "context"))
    assert patterns == 20 and found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == patterns


def test_blob_keeps_its_space(spark):
    assert value(spark, item_blob(F.col("t"), F.lit(None)), t="A") == "a "
    assert isinstance(ITEMS, T.StructType)


def test_a_run_and_its_repeat(spark, tmp_path):
    from intentloom.operators import run

    lex = WebLexicon(intent=("want to buy", "buy", "to buy", "want"), timeframe=("2026",), pronoun=("i ",), gazetteer=LEX.gazetteer, personal=("i want",))
    good = "i want to buy 2026 alpha " + "y" * 460
    search = items(spark, good, "nothing", good + " z")
    news = items(spark, "to buy 2026 beta, i say " + "y" * 460, source="n", query_idx=7).withColumn("url", F.lit("n0"))
    go = lambda when: run.scan(search, news, messages(spark, "buy where 200k"), lex, CHAT, when, when, 10, str(tmp_path / "s"), str(tmp_path / "l"))
    one_, again, later = go(NOW), go(NOW), go(datetime(2026, 1, 31, 1))
    assert (one_.web.count(), one_.chat.count(), one_.alerts.count()) == (3, 1, 3)
    assert (again.web.count(), again.chat.count()) == (3, 1)
    assert (later.web.count(), later.chat.count(), later.alerts.count()) == (0, 0, 1)
    record = one(one_.record)
    assert (record.unique_results, record.new_hot_warm, record.source_counts) == (4, 3, {"Chat": 1, "n": 1, "s": 3})
    assert (record.errors, record.source_errors, record.chat_status, record.chat_groups, record.chat_messages_scanned) == (0, {"n": 0, "s": 0}, "completed", 1, 1)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2


def test_what_a_scan_reads_and_counts(spark, tmp_path):
    from intentloom.operators import run

    text = ["buy where 200k"] * 3 + [None, ""] * 249 + ["buy where 200k"]  # the newest 500 of 502 messages
    chat = messages(spark, *text).withColumn("date", F.expr("date - make_interval(0, 0, 0, 0, 0, 0, 600 - message_id)"))
    chat = chat.unionByName(chat.limit(1).withColumn("group_id", F.lit(2).cast("long")).withColumn("date", F.lit(None).cast("timestamp")))
    chat = chat.unionByName(chat.limit(1).withColumn("group_id", F.lit(3).cast("long")))
    groups = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "group_id long, is_group boolean")
    assert sorted(r.message_id for r in run.recent_messages(chat, NOW, groups=groups).collect()) == [2, 501]
    assert run.recent_messages(chat, NOW, per_group=1000, groups=groups).count() == 4 and run.recent_messages(chat, NOW).count() == 3
    search = items(spark, "x").withColumn("url", F.lit("http://a.example/")).unionByName(items(spark, "y").withColumn("url", F.lit("http://b.example/")))
    news = items(spark, "n", "m", source="news", query_idx=11)
    more = {
        "groups": groups, "domains": spark.createDataFrame([(1, "a.example")], "query_idx int, domain string"), "failures": spark.createDataFrame([("s", 2), ("feed", 1)], "source string, errors int"),
        "priorities": spark.createDataFrame([("club", "MEDIUM")], "name string, priority string"), "routes": spark.createDataFrame([("first", "Way")], "market string, route_to string"),
    }
    found = run.scan(search, news, chat, LEX, CHAT, NOW, NOW, 13, str(tmp_path / "s"), str(tmp_path / "l"), **more)
    r = one(found.record)
    assert (r.chat_groups, r.chat_messages_scanned, r.errors, r.source_errors, r.source_counts, r.unique_results) == (3, 2, 3, {"feed": 1, "s": 2}, {"Chat": 2, "s": 1}, 1)
    assert {x.group_priority for x in found.chat.collect()} == {"MEDIUM"}
    broken = run.scan(search, news, chat.drop("date"), LEX, CHAT, NOW, NOW, 13, str(tmp_path / "s2"), str(tmp_path / "l2"))
    r = one(broken.record)
    assert (r.chat_status, r.chat_groups, r.chat_messages_scanned, r.chat_new_hot_warm) == ("error", 0, 0, 0)
    assert (r.errors, r.source_errors["Chat"], r.results_per_query, r.quality_gate[:8]) == (1, 1, 5, "personal")
    late = datetime(2026, 2, 1)  # what was stored before the failure counts
    ledger.append(found.chat.drop("run_id"), str(tmp_path / "s3/chat"), run_id=late.strftime("%Y%m%dT%H%M%SZ"))
    broken = run.scan(search, news, chat.drop("date"), LEX, CHAT, late, late, 13, str(tmp_path / "s3"), str(tmp_path / "l3"))
    assert (one(broken.record).chat_new_hot_warm, broken.chat.count(), one(broken.record).errors) == (2, 2, 1)
    for reason in run.SKIPPED:
        r = one(run.scan(search, news, chat, LEX, CHAT, NOW, NOW, 13, str(tmp_path / "s4"), str(tmp_path / "l4"), chat_skipped=reason).record)
        assert (r.chat_status, r.chat_groups, r.errors, r.source_counts["Chat"]) == (reason, 0, 0, 0)
    assert one(run.scan(search, news, None, LEX, CHAT, NOW, NOW, 13, str(tmp_path / "s5"), str(tmp_path / "l5")).record).chat_status == "skipped"
    with pytest.raises(ValueError):
        run.scan(search, news, chat, LEX, CHAT, NOW, NOW, 13, str(tmp_path / "s6"), str(tmp_path / "l6"), chat_skipped="tired")


def test_a_run_reads_each_input_once(spark, tmp_path):
    """The record's counts come from the jobs that make the leads."""
    hits = [("s" if i % 3 else "t", f"http://a.example/{i % 7}", "", f"i want to buy 2026 alpha {i % 7}", None, "", 1, i) for i in range(30)]
    names = "source string, url string, title string, text string, published string, author string, query_idx int, pos int"
    spark.createDataFrame(hits, names).write.parquet(str(tmp_path / "hits"))
    messages(spark, "buy where 200k", "hello", "").write.parquet(str(tmp_path / "chat"))
    read = lambda n: spark.read.parquet(str(tmp_path / n))
    store = spark._jsparkSession.sharedState().statusStore()
    last = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    before = max((e.executionId() for e in last()), default=-1)
    found = run.scan(read("hits"), read("hits").limit(0), read("chat"), LEX, CHAT, NOW, NOW, 9, str(tmp_path / "s"), str(tmp_path / "l"), sources=("s", "t", "none"))
    r = one(found.record)
    plans = [e.physicalPlanDescription() for e in last() if e.executionId() > before]
    assert [sum(f"{tmp_path}/{n}]" in p for p in plans) for n in ("hits", "chat")] == [1, 1]
    assert (r.unique_results, r.source_counts, r.chat_groups, r.chat_messages_scanned) == (7, {"Chat": r.chat_new_hot_warm, "s": 20, "t": 10}, 1, 2)
    assert one(summary.unique_over_runs(spark.read.parquet(str(tmp_path / "l")))).unique_results == 7


def test_iso_dates_as_the_standard_library_reads_them(spark):
    texts = [
        "2024-01-31", "20240131", "2024-01-31T10:30:05", "20240131T103005", "20240131T1030", "2024-01-31T10", "2024-01-31 10:30:05.123456", "20240131T103005,5", "2024-01-31T10:30:05.1234567", "2024-01-31T10:30Z",
        "20240131T103005Z", "20240131T103005+0230", "2024-01-31T10:30:05-05:00", "20240131T10+02", "2024-W05-3", "2024W053", "2024-W05", "2024W05T1030", "2026-W53-1", "2025-W53-1", "2024-W00-1", "2024-02-30", "20240230",
        "2024-01-31T24:30", "2024", "2024-11", "202411", "10:00", "garbage", "", "Mon, 01 Jan 2024 00:00:00 GMT", "2024-1-3", "2024-01-31T10:30:05+0230x",
    ]

    def read(t):
        try:
            at = datetime.fromisoformat(t)
        except ValueError:
            return None
        return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", F.date_format(P.iso_timestamp(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
    assert {r.t: r.at for r in rows} == {t: read(t) and read(t).strftime("%Y-%m-%d %H:%M:%S.%f") for t in texts}


def test_weights_are_parameters(spark):
    rows = items(spark, "i want to buy 2026 alpha for sale")
    plain, other = (one(leads.scored_items(rows, LEX, weights=w)) for w in (WebWeights(), WebWeights(intent=50, per_exclude=1, per_doubt=2, known_market=90, hot=(80, 50, 90))))
    assert (plain.intent_score, plain.credibility_score, plain.market_fit_score, plain.classification) == (35 + 7 + 12 + 10 + 8 - 20, 55 + 12 + 10 + 8 - 25, 67, "REVIEW")
    assert (other.intent_score, other.credibility_score, other.market_fit_score, other.classification) == (86, 83, 100, "HOT")
    chat = messages(spark, "buy where 200k")
    usual = one(leads.scored_messages(chat, CHAT))
    more = one(leads.scored_messages(chat, CHAT, weights=ChatWeights(buy=(40, 40), budget=1, hot=200, hot_question=200, warm=1)))
    assert more.chat_score - usual.chat_score == 40 - 18 + 1 - 12 and more.classification == "WARM"


def test_what_does_not_parse_goes_to_quarantine(spark):
    good = '{"results": [{"url": "u", "title": " t ", "extra": 1}, {"text": "x"}]}'
    replies = [good, "{}", '{"results": null}', "[", "", "  ", None, '{"results": 5}', '{"results": [{"url": {"a": 1}}]}', "plain", good[:-1]]
    parsed = feeds.json_results(spark.createDataFrame(list(enumerate(replies)), "query_idx int, json string"))
    assert sorted((r.query_idx, r.url, r.title, r.text) for r in parsed.items.collect() if r.query_idx < 8) == [(0, "", "", "x"), (0, "u", "t", "")]
    faults = {r.query_idx: (r.fault, r.raw) for r in parsed.quarantined.collect()}
    assert {k: v[0] for k, v in faults.items() if k != 8} == {3: "corrupt", 4: "missing", 5: "missing", 6: "missing", 7: "corrupt", 9: "corrupt", 10: "corrupt"}
    assert faults[9][1] == "plain" and one(parsed.faults()) == ("search", len(faults))
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="u"/><title>A &amp; B</title></entry></feed>'
    for read, text, url, title in ((feeds.feed_atom, atom, "u", "A & B"), (feeds.feed_rss, "<rss><channel><item><link> v </link><title>T</title></item></channel></rss>", "v", "T")):
        parsed = read(spark.createDataFrame(list(enumerate([text, text[:-9], "no markup", None, ""])), "query_idx int, xml string"))
        assert [(r.query_idx, r.url, r.title) for r in parsed.items.collect()] == [(0, url, title)]
        assert {r.query_idx: r.fault for r in parsed.quarantined.collect()} == {1: "corrupt", 2: "corrupt", 3: "missing", 4: "missing"}


def test_only_what_matches_is_sent(spark):
    """Words that many phrases share bring nothing to a text that has none of these phrases; before, each was met by a common gram."""
    lexicon = spark.range(3_000).select(F.concat(F.lit("words "), (F.col("id") % 50).cast("string"), F.lit(" shared "), F.col("id").cast("string"), F.lit("!")).alias("phrase"))
    texts = spark.range(400).select(F.col("id").alias("key_"), F.concat(F.repeat(F.lit("words shared words 1 shared "), 20), F.when(F.col("id") % 40 == 0, F.lit("words 7 shared 57! words 8 shared 108! words 7 shared 57!")).otherwise("")).alias("blob_"))
    sent = P.sent_grams(texts, P.chosen_grams(lexicon))
    assert {r.key_ for r in sent.where("gram = 'words 7 shared 57!'").collect()} == set(range(0, 400, 40)) and 20 <= sent.count() <= 40


def test_large_lexicons_equal_brute_force(spark):
    """Phrases of one letter to more than are followed letter by letter, of letters of one to four bytes, in texts long and short."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab é\U0001f600") for _ in range(n))
    texts = [text(rng.choice((0, 1, 7, 60, 900))) for _ in range(120)] + ["", None, text(400_000)]
    long = [t[at : at + n] for t in texts[:120] if t for at, n in ((0, 90), (3, 200), (len(t) - 70, 70)) if at >= 0]
    phrases = [p for p in [*long, *(text(rng.randrange(1, 9)) for _ in range(150))] if p]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = {r.k: r.hits for r in P.phrase_hits_join(rows, "k", "t", spark.createDataFrame([(p,) for p in phrases], "phrase string"), 5).collect()}
    assert got == {k: sum(p in t for p in phrases) if t is not None else 0 for k, t in enumerate(texts)}


@pytest.mark.parametrize(("by_table", "rows"), [(S.market_first_match_join, 1), (S.market_argmax_join, 2)])
@pytest.mark.parametrize("most", [100, 0])
def test_repeated_places_are_combined_before_they_match(spark, monkeypatch, by_table, rows, most):
    """A place that stands in a gazetteer 1,000 times brings a match one row, or one for each of its markets; before, it brought 1,000."""
    matched, real = [], S._matched_terms
    monkeypatch.setattr(S, "_matched_terms", lambda *a: matched.append(real(*a)) or matched[-1])
    table = spark.range(1_000).select(F.when(F.col("id") < 400, "one").otherwise("two").alias("market"), F.when(F.col("id") < 400, 7).otherwise(3).alias("market_ord"), F.lit("place").alias("term"))
    got = by_table(spark.createDataFrame([(1, "a place"), (2, "none")], "k int, t string"), "k", "t", table, most)
    assert {r.k: r.market for r in got.collect()} == {1: "two", 2: "unknown"} and matched[0].count() == rows
