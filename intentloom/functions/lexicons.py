"""Lexicons as data: phrases, patterns, places, routes and priorities, with small defaults of our own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """A regular expression and, if known, a lower-case string that each of its matches contains."""

    regex: str
    core: str = ""


@dataclass(frozen=True)
class WebLexicon:
    """Lists for web items. The order of `gazetteer` decides between places of two markets."""

    intent: tuple[str, ...] = ("want to buy", "looking to buy", "ready to purchase", "budget of", "cash buyer")
    exclude: tuple[str, ...] = ("contact our team", "for sale", "we sell", "estate agent")
    listing: tuple[str, ...] = ("bedrooms", "square metres", "price on request", "view listing")
    personal: tuple[str, ...] = ("i am looking", "we are looking", "my family", "i want")
    negative: tuple[str, ...] = ("already bought", "no longer looking", "gave up")
    excluded_places: tuple[str, ...] = ("dubai", "america")
    timeframe: tuple[str, ...] = ("month", "within", "soon", "next year")
    pronoun: tuple[str, ...] = ("i ", "we ", "my ", "our ")
    gazetteer: tuple[tuple[str, tuple[str, ...]], ...] = (("greece", ("athens", "crete")), ("france", ("paris", "lyon")), ("germany", ("berlin", "munich")))
    premium: tuple[str, ...] = ("france",)
    routes: tuple[tuple[str, str], ...] = (("greece", "South desk"), ("france", "West desk"), ("germany", "Central desk"))
    default_route: str = "Direct Review"


@dataclass(frozen=True)
class ChatLexicon:
    """Lists for chat messages; patterns are matched on folded text."""

    buy: tuple[Pattern, ...] = (Pattern(r"\b(?:want|looking) to buy\b", "to buy"), Pattern(r"\bi need an? (?:flat|house)\b", "i need a"))
    weak: tuple[Pattern, ...] = (Pattern(r"\bany offers\b", "any offers"),)
    sell: tuple[Pattern, ...] = (Pattern(r"\bselling\b", "selling"), Pattern(r"\bfor sale\b", "for sale"))
    rent: tuple[Pattern, ...] = (Pattern(r"\bto rent\b", "to rent"),)
    context: tuple[Pattern, ...] = (Pattern(r"\bhow much\b", "how much"), Pattern(r"\bwhere can\b", "where can"))
    negative: tuple[str, ...] = ("already bought", "not looking any more")
    nouns: tuple[str, ...] = ("flat", "house", "villa")
    gazetteer: tuple[tuple[str, tuple[str, ...]], ...] = WebLexicon.gazetteer
    high: tuple[str, ...] = ("buyers club",)
    medium: tuple[str, ...] = ("expat chat",)


# Points, caps and bounds of scores and labels, as results have to have them.


@dataclass(frozen=True)
class WebWeights:
    """Points of web items: bases, per hit or flag; and the least intent, credibility and fit of a label."""

    intent: int = 35
    per_intent: int = 7
    per_exclude: int = 20
    credibility: int = 55
    long_text: int = 10
    long_over: int = 450
    per_doubt: int = 25
    budget: int = 12
    timeframe: int = 10
    pronoun: int = 8
    known_market: int = 55
    unknown_market: int = 35
    premium: int = 8
    hot: tuple[int, int, int] = (82, 75, 60)
    warm: tuple[int, int, int] = (62, 65, 45)


@dataclass(frozen=True)
class ChatWeights:
    """Points of messages: (each, at most) for evidence, then flags and priorities; and the least score of a label, with and without a question."""

    buy: tuple[int, int] = (18, 60)
    weak: tuple[int, int] = (5, 18)
    context: tuple[int, int] = (4, 12)
    sell: tuple[int, int] = (30, 75)
    rent: tuple[int, int] = (35, 75)
    budget: int = 12
    negative: int = 50
    high: int = 14
    medium: int = 7
    hot: int = 65
    hot_question: int = 50
    warm: int = 35
    warm_question: int = 30
    review: int = 15


def words(*found: str) -> tuple[Pattern, ...]:
    """Patterns for whole words."""
    return tuple(Pattern(rf"\b{w}\b", w) for w in found)


#: Lists whose entries occur in the invented prose of the test tables.
PROSE_WEB = WebLexicon(
    intent=("the ", "with ", "from ", "that ", "und ", "nicht", "les ", "avec", "para ", "los "),
    exclude=("licens", "@", "%%%"),
    listing=("thing", "eren", "tion", "eaux"),
    personal=("the ", "les ", "und "),
    negative=("$$$", "eaux"),
    excluded_places=("|",),
    timeframe=("this", "by "),
    pronoun=("it ", "le "),
    gazetteer=(("m_de", ("und ", "für ")), ("m_fr", ("avec", "dans ")), ("m_es", ("para ", "los "))),
    premium=("m_de", "m_fr"),
    routes=(("m_de", "North desk"), ("m_fr", "West desk")),
)
PROSE_CHAT = ChatLexicon(
    buy=words("the", "with", "les", "und", "para", "that", "avec", "nicht"),
    weak=(*words("is", "der", "con"), *words("is")),
    sell=words("from", "dans", "als"),
    rent=words("this", "pour"),
    context=words("and", "qui", "ist"),
    negative=("eaux",),
    nouns=("tion",),
    gazetteer=PROSE_WEB.gazetteer,
    high=("user",),
    medium=("system",),
)
