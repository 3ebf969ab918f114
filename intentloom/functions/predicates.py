"""Lexicon and pattern predicates as columns.

Each takes prepared text. Hit counts are substring tests that Catalyst compiles; `steady` keeps them
from being evaluated a second time when a filter on them is pushed below their projection.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial, reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.functions import phrases as stretch
from intentloom.functions.lexicons import ChatLexicon, Pattern, WebLexicon
from intentloom.functions.text import fold_text, text_or_empty
from intentloom.session import work_folder

# What counts as a budget in web items and in chat messages.
BUDGET_WEB = r"(?U)[$€£₺]\s?[\d,.]+|\b\d{2,3}\s?[kKmM]\b|\b\d{4,}\b"
BUDGET_CHAT = r"(?iU)(?:£|€|\$|₺|₽)\s?\d[\d\s.,]*|\b\d[\d\s.,]*\s?(?:gbp|eur|usd|try|tl|руб|млн|million|k)\b"
#: A date written in full, perhaps with a time: what both an ISO parser and Spark read alike.
FULL_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
WEEK_DATE = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|[T ])"
#: Steps from basic ISO forms to extended ones: date, times of three, two and one part, seconds, fractions, offsets of two and one part.
EXTENDED = (
    (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3"), (r"([T ]\d{2})(\d{2})(\d{2})(?=$|[.,Z+-])", "$1:$2:$3"), (r"([T ]\d{2})(\d{2})(?=$|[Z+-])", "$1:$2"), (r"([T ]\d{2})(?=$|[Z+-])", "$1:00"),
    (r"([T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00"),
    (r"(:\d{2}:\d{2})[.,](\d{1,6})\d*", "$1.$2"), (r"([T ][\d:.]+[+-]\d{2})(\d{2})$", "$1:$2"), (r"([T ][\d:.]+[+-]\d{2})$", "$1:00"),
)



def steady(c: Column) -> Column:
    """`c` plus a zero that Spark may not copy, so that one evaluation serves projection and filter."""
    return c + (F.rand(1) * 0).cast("int")


def held(c: Column) -> Column:
    """`c` of any type, evaluated once: Spark may not copy it into filters or later projections."""
    return F.when(F.rand(1) * 0 >= 0, c)


def phrase_hits(blob: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur as substrings; each counts once."""
    return reduce(lambda a, b: a + b, [F.contains(blob, F.lit(p.lower())).cast("int") for p in phrases], F.lit(0))


def any_phrase(blob: Column, phrases: Iterable[str]) -> Column:
    return reduce(or_, [F.contains(blob, F.lit(p.lower())) for p in phrases], F.lit(False))


#: Rows of a lexicon that are sent to all tasks at most; larger ones are joined by a shuffle of what stands in the texts.
BROADCAST_ROWS = 1_000_000


def phrase_hits_join(frame: DataFrame, key: str, blob: str, lexicon: DataFrame, most: int = 10_000) -> DataFrame:
    """(key, hits): as phrase_hits, from a lexicon table with a column phrase. Keys are distinct, one may be null; null phrases don't count, a repeated one counts again.

    A table of at most `most` phrases becomes one array that every row is tested against, without a row per pair or a
    shuffle. A larger one is joined with what stands in the texts, see phrase_matches. Either way gives the same.
    """
    phrases = lexicon.where("phrase is not null").groupBy(F.lower("phrase").alias("phrase")).agg(F.count("*").alias("times"))
    found = phrase_matches(frame, key, blob, phrases, most)
    if isinstance(found, Column):
        each = [r[0] for r in phrases.select("times").distinct().collect()]
        if each in ([], [1]):
            return frame.select(key, F.coalesce(F.size(found), F.lit(0)).alias("hits"))
        found = frame.select(F.col(key).alias("key_"), F.explode(found).alias("phrase")).join(phrases, "phrase")
    hits = found.groupBy("key_").agg(F.sum("times").alias("some"))
    return frame.join(hits, F.col(key).eqNullSafe(F.col("key_")), "left").select(key, F.coalesce("some", F.lit(0)).cast("int").alias("hits"))


def phrase_matches(frame: DataFrame, key: str, blob: str, phrases: DataFrame, most: int = 10_000) -> Column | DataFrame:
    """Which of the non-null `phrases` (column phrase, taken as they are) occur in each row's blob.

    Up to `most` distinct phrases: an array column for `frame`. More: a table (key_, phrase, and the other columns of `phrases`), a row per key and row of `phrases`. Tasks find
    the stretches of a text that are phrases by hash (see sent_grams) and these meet the phrases by equality, so neither a text nor a pair that does not match is ever sent. Up to
    BROADCAST_ROWS of phrases go to where the texts are, and then what follows can be combined before any shuffle. Null blobs match nothing, the empty phrase all others.
    """
    known = [r[0] for r in phrases.select("phrase").distinct().limit(most + 1).collect()]
    if len(known) <= most:
        return F.filter(F.array(*map(F.lit, known)).cast("array<string>"), lambda p: F.contains(F.col(blob), p))
    spark, path = frame.sparkSession, work_folder(frame.sparkSession, "phrases")
    phrases.write.parquet(path)  # made once, as it is read several times
    phrases = spark.read.schema(phrases.schema).parquet(path)
    few = phrases.count() <= BROADCAST_ROWS
    texts, empty = frame.select(F.col(key).alias("key_"), F.col(blob).alias("blob_")), phrases.where("phrase = ''")
    there = phrases.where("phrase <> ''")
    found = sent_grams(texts, chosen_grams(there)).withColumnRenamed("gram", "phrase").join(F.broadcast(there) if few else there, "phrase")
    columns = ["key_", *phrases.columns]
    found = found.select(*columns)
    if empty.limit(1).count():
        found = found.unionByName(texts.where("blob_ is not null").select("key_").crossJoin(F.broadcast(empty) if few else empty).select(*columns))
    return found


def chosen_grams(phrases: DataFrame) -> DataFrame:
    """(phrase, n): the distinct phrases with the length, in bytes, of the stretch that each is met by: the whole of it."""
    return phrases.select("phrase", F.octet_length("phrase").alias("n")).distinct()


def gram_bitmap(chosen: DataFrame) -> tuple[list[int], int, np.ndarray]:
    """The lengths of the chosen stretches, the bits of a place and the bitmap of their hashes; what reaches the driver is at most the lengths and the bitmap (16 MB)."""
    counts = chosen.groupBy("n").agg(F.count("*").alias("phrases")).collect()
    lengths = sorted(r["n"] for r in counts)
    followed = [n for n in lengths if n <= stretch.FOLLOWED]
    bits = stretch.bits_for(sum(r["phrases"] * (1 + sum(n < r["n"] for n in followed)) for r in counts))
    words = chosen.select("phrase").mapInArrow(partial(stretch.bitmap_words, lengths=lengths, bits=bits), "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return lengths, bits, out.view(np.uint8)


def sent_grams(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key_, gram) of `texts` (key_, blob_): the distinct stretches of each text whose hash is that of a chosen phrase, and by chance a few others."""
    lengths, bits, bitmap = gram_bitmap(chosen)
    kinds = T.StructType([T.StructField("key_", texts.schema["key_"].dataType), T.StructField("gram", T.StringType())])
    return texts.where("blob_ is not null").mapInArrow(partial(stretch.stretches, lengths=lengths, bits=bits, bitmap=bitmap), kinds)


def listing_gate(blob: Column, phrases: Iterable[str]) -> Column:
    """Looks like a listing: two phrases or more."""
    return phrase_hits(blob, phrases) >= 2


personal_gate = negative_gate = excluded_market_gate = timeframe_flag = pronoun_flag = any_phrase


def iso_timestamp(text: Column) -> Column:
    """The instant of an ISO date: 2024-01-31, 20240131, 2024-W05-3 or 2024W053, alone (midnight) or with a time such as T10:30, T103000.5 or T10+0200; without offset UTC.

    Null for anything else, also for dates that no calendar has. Between date and time stands a T or a space.
    """
    week = lambda t, i: F.regexp_extract(t, WEEK_DATE, i)
    number = lambda t, i: F.when(week(t, i) != "", week(t, i).cast("int"))

    def by_week(t: Column) -> Column:
        first = F.date_trunc("week", F.make_date(number(t, 1), F.lit(1), F.lit(4))).cast("date")
        day = F.date_add(first, (number(t, 2) - 1) * 7 + F.coalesce(number(t, 3), F.lit(1)) - 1)
        return _once(day, lambda d: F.when(number(t, 2).between(1, 53) & (F.weekofyear(d) == number(t, 2)), F.concat(d.cast("string"), F.regexp_replace(t, WEEK_DATE, ""))))

    def extended(t: Column) -> Column:
        full = reduce(lambda c, step: F.regexp_replace(c, *map(F.lit, step)), EXTENDED, t)
        return _once(full, lambda c: F.when(c.rlike(FULL_DATE), F.try_to_timestamp(c)))

    return _once(F.when(text.rlike(WEEK_DATE), by_week(text)).otherwise(text), extended)


def _once(c: Column, use) -> Column:
    """`use(c)` with `c` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(c), use), 1)


def recency_gate(published: Column, as_of: Column, days: int = 90) -> Column:
    """Keeps what was published in the last `days`, the bound included, and what has no ISO date in full."""
    return F.coalesce(iso_timestamp(text_or_empty(published)) >= as_of - F.make_dt_interval(F.lit(days)), F.lit(True))


def pattern_matches(text: Column, patterns: Iterable[Pattern]) -> Column:
    """First match of each pattern that matches, in order; a repeated pattern counts again. `text` is folded."""
    found = []
    for p in patterns:
        match = F.regexp_extract(text, f"(?iU){p.regex}", 0)
        found.append(F.when(F.contains(text, F.lit(p.core)), match).otherwise("") if p.core else match)
    if not found:
        return F.array().cast("array<string>")
    return F.filter(F.array(*found), lambda x: x != "")


def budget_web(blob: Column) -> Column:
    return blob.rlike(BUDGET_WEB)


def budget_chat(text: Column) -> Column:
    return text_or_empty(text).rlike(BUDGET_CHAT)


def buyer_question(noun: Column, context: Column, buy: Column, budget: Column) -> Column:
    """A question of a buyer: context, and a buying phrase, a budget or a property noun."""
    return (F.size(context) > 0) & ((F.size(buy) > 0) | budget | noun)


def quality_gate(blob: Column, published: Column, as_of: Column, lex: WebLexicon) -> Column:
    """The gates of search hits, cheap ones first."""
    return reduce(and_, [
        any_phrase(blob, lex.personal), ~any_phrase(blob, lex.excluded_places), ~any_phrase(blob, lex.negative),
        ~listing_gate(blob, lex.listing), recency_gate(published, as_of),
    ])


def label_filter(label: Column) -> Column:
    return label.isin("HOT", "WARM")


def chat_matches(text: Column, lex: ChatLexicon) -> dict[str, Column]:
    """The five evidence arrays of a message."""
    folded = fold_text(text)
    return {f"{kind}_matches": pattern_matches(folded, getattr(lex, kind)) for kind in ("buy", "weak", "sell", "rent", "context")}
