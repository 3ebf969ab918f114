"""Scores, labels, markets and routes as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentloom.functions.lexicons import ChatWeights, WebWeights
from intentloom.functions.predicates import any_phrase, phrase_matches
from intentloom.functions.text import fold_text, text_or_empty

Gazetteer = Sequence[tuple[str, Sequence[str]]]


def _if(flag: Column, points: int) -> Column:
    return F.when(flag, points).otherwise(0)


def market_first_match(blob: Column, gazetteer: Gazetteer) -> Column:
    """The first market, in the gazetteer's order, one of whose places occurs; else 'unknown'."""
    found = [F.when(any_phrase(blob, terms), F.lit(market)) for market, terms in gazetteer]
    return F.coalesce(*found, F.lit("unknown"))


def _matched_terms(frame: DataFrame, key: str, blob: str, terms: DataFrame, most: int) -> DataFrame:
    """(key_, and the other columns of `terms`), a row per row of `terms` (column phrase) whose phrase occurs."""
    found = phrase_matches(frame, key, blob, terms, most)
    if isinstance(found, Column):
        found = frame.select(F.col(key).alias("key_"), F.explode(found).alias("phrase")).join(terms, "phrase")
    return found.drop("phrase")


def _with_market(frame: DataFrame, key: str, best: DataFrame) -> DataFrame:
    out = frame.join(best, F.col(key).eqNullSafe(F.col("key_")), "left").drop("key_")
    return out.withColumn("market", F.coalesce("market", F.lit("unknown")))


def market_first_match_join(frame: DataFrame, key: str, blob: str, gazetteer: DataFrame, most: int = 10_000) -> DataFrame:
    """`frame` with market as market_first_match gives it, from a table (market, market_ord, term) of any size: of the markets whose terms occur the one of least market_ord.

    Of the rows of a term only the first market counts, before anything is matched. Terms are matched as in phrase_matches; a match is a row of a key and a number, combined before the shuffle. Keys are distinct, one may be null. A column market is replaced.
    """
    frame, order = frame.drop("market"), F.struct("market_ord", "market")
    first = gazetteer.where("term is not null").groupBy(F.lower("term").alias("phrase")).agg(F.min(order).alias("first"))
    # Markets in order as whole numbers: a minimum of these needs no sort. Numbered within their market_ord, of which a market has its own.
    ranked = gazetteer.select("market_ord", "market").distinct().withColumn("place", F.row_number().over(Window.partitionBy("market_ord").orderBy("market")))
    ranked = ranked.withColumn("code", F.coalesce(F.col("market_ord").cast("long") * F.lit(1 << 31), F.lit(-(1 << 63))) + F.col("place"))
    of = ranked.select(F.col("market_ord").alias("ord_"), F.col("market").alias("name_"), "code")
    terms = first.join(of, F.col("first.market_ord").eqNullSafe(F.col("ord_")) & F.col("first.market").eqNullSafe(F.col("name_"))).select("phrase", "code")
    least = _matched_terms(frame, key, blob, terms, most).groupBy("key_").agg(F.min("code").alias("code"))
    return _with_market(frame, key, least.join(ranked.select("code", "market"), "code").drop("code"))


def market_argmax_join(frame: DataFrame, key: str, blob: str, gazetteer: DataFrame, most: int = 10_000) -> DataFrame:
    """`frame` with market as market_argmax gives it, from a table (market, market_ord, term) of any size: the market with most of its terms present, of equals that of
    the least market_ord. Terms are compared as they are, repeated ones count again; else as market_first_match_join."""
    frame = frame.drop("market")
    terms = gazetteer.where("term is not null").groupBy(F.col("term").alias("phrase"), "market").agg(F.count("*").alias("times"), F.min("market_ord").alias("ord"))
    votes = _matched_terms(frame, key, blob, terms, most).groupBy("key_", "market").agg(F.sum("times").alias("n"), F.min("ord").alias("ord"))
    best = votes.groupBy("key_").agg(F.max_by("market", F.struct("n", (-F.col("ord")).alias("ord"))).alias("market"))
    return _with_market(frame, key, best)


def intent_score(intent: Column, exclude: Column, budget: Column, timeframe: Column, personal: Column, w: WebWeights = WebWeights()) -> Column:
    """At most 100, without a floor."""
    return F.least(F.lit(100), w.intent + intent * w.per_intent + _if(budget, w.budget) + _if(timeframe, w.timeframe) + _if(personal, w.pronoun) - exclude * w.per_exclude)


def credibility_score(blob: Column, exclude: Column, budget: Column, timeframe: Column, personal: Column, w: WebWeights = WebWeights()) -> Column:
    """At most 100, without a floor; texts over `long_over` characters gain."""
    raw = w.credibility + _if(budget, w.budget) + _if(timeframe, w.timeframe) + _if(F.length(blob) > w.long_over, w.long_text) + _if(personal, w.pronoun) - exclude * w.per_doubt
    return F.least(F.lit(100), raw)


def market_fit_score(market: Column, budget: Column, premium: Sequence[str], w: WebWeights = WebWeights()) -> Column:
    """0 to 100."""
    raw = F.when(market != "unknown", w.known_market).otherwise(w.unknown_market) + _if(budget, w.budget) + _if(market.isin(*premium), w.premium)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def web_label(intent: Column, credibility: Column, fit: Column, w: WebWeights = WebWeights()) -> Column:
    reaches = lambda least: (intent >= least[0]) & (credibility >= least[1]) & (fit >= least[2])
    return F.when(reaches(w.hot), "HOT").when(reaches(w.warm), "WARM").otherwise("REVIEW")


def group_priority(name: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    """HIGH, MEDIUM or NORMAL by equality of folded names; the lists are folded as the name is."""
    folded = fold_text(name)
    member = lambda names: F.exists(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: fold_text(n) == folded)
    return F.when(member(high), "HIGH").when(member(medium), "MEDIUM").otherwise("NORMAL")


def group_priority_join(groups: DataFrame, name: str, priorities: DataFrame) -> DataFrame:
    """`groups` with group_priority from a table (name, priority): a left join on folded names, HIGH before MEDIUM."""
    table = priorities.groupBy(fold_text(F.col("name")).alias("folded")).agg(F.min("priority").alias("group_priority"))
    out = groups.withColumn("folded", fold_text(F.col(name))).join(table, "folded", "left").drop("folded")
    return out.withColumn("group_priority", F.coalesce("group_priority", F.lit("NORMAL")))


def route_lookup(frame: DataFrame, routes: DataFrame, default: str, market: str = "market") -> DataFrame:
    """`frame` with route_to from a table (market, route_to); one row per market is taken, the least route."""
    table = routes.groupBy(F.col("market").alias(market)).agg(F.min("route_to").alias("route_to"))
    return frame.join(table, market, "left").withColumn("route_to", F.coalesce("route_to", F.lit(default)))


def route_of(market: Column, routes: Sequence[tuple[str, str]], default: str) -> Column:
    """As route_lookup, for a fixed list."""
    return F.coalesce(*[F.when(market == m, F.lit(to)) for m, to in routes], F.lit(default))


def market_argmax(blob: Column, gazetteer: Gazetteer) -> Column:
    """The market with most of its terms present, the earlier one on a tie; 'unknown' without any.

    Terms are compared as they are, unfolded, with the folded blob.
    """
    votes = [
        F.struct(sum((F.contains(blob, F.lit(t)).cast("int") for t in terms), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(market).alias("market"))
        for i, (market, terms) in enumerate(gazetteer)
    ]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["market"]).otherwise("unknown")


def chat_score(buy: Column, weak: Column, sell: Column, rent: Column, context: Column, budget: Column, negative: Column, priority: Column, w: ChatWeights = ChatWeights()) -> Column:
    """0 to 100 from the evidence arrays and flags."""
    capped = lambda c, points: F.least(F.lit(points[1]), F.size(c) * points[0])
    raw = (
        capped(buy, w.buy) + capped(weak, w.weak) + capped(context, w.context) + _if(budget, w.budget)
        + F.when(priority == "HIGH", w.high).when(priority == "MEDIUM", w.medium).otherwise(0)
        - capped(sell, w.sell) - capped(rent, w.rent) - _if(negative, w.negative)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def chat_label(score: Column, buy: Column, sell: Column, rent: Column, question: Column, negative: Column, priority: Column, w: ChatWeights = ChatWeights()) -> Column:
    """Rejections first, in this order, then the score's bands."""
    asks = (F.size(buy) > 0) | question
    return (
        F.when((F.size(rent) > 0) & ~asks, "REJECT_RENT")
        .when((F.size(sell) > 0) & ~asks, "REJECT_SELLER")
        .when(negative, "REJECT_STATUS")
        .when((score >= w.hot) | (question & (priority == "HIGH") & (score >= w.hot_question)), "HOT")
        .when((score >= w.warm) | (question & priority.isin("HIGH", "MEDIUM") & (score >= w.warm_question)), "WARM")
        .when(score >= w.review, "REVIEW")
        .otherwise("LOW")
    )


def sender_label(username: Column, first: Column, last: Column) -> Column:
    """@username, else first and last name, else ''."""
    full = F.trim(F.concat(text_or_empty(first), F.lit(" "), text_or_empty(last)))
    return F.when(text_or_empty(username) != "", F.concat(F.lit("@"), username)).otherwise(full)


def message_link(base: str, username: Column, message_id: Column) -> Column:
    """Link of a message of a named group, else ''."""
    return F.when(text_or_empty(username) != "", F.concat(F.lit(base), username, F.lit("/"), message_id.cast("string"))).otherwise("")


def group_label(name: Column, username: Column, group_id: Column) -> Column:
    """Name, else username, else the id."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(username, F.lit("")), group_id.cast("string"))
