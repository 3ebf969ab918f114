"""Licence scans in native columns: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence id -> notice as licensors word it.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}

#: Units of a text that are compared with the templates.
UNITS = {"line": r"\n", "paragraph": r"\n[ \t\r]*\n"}


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: Column) -> Column:
    """A-Z lower-cased, every run of other characters than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(lower(text), "[^a-z0-9]+", " "))


def needed_words(grams: list[str], least: float) -> set[str]:
    """Words of which every text that reaches `least` against a template has one.

    The text's bigrams and the template's share at least least / (2 - least) of the template's, so any choice of more bigrams than may be missing
    has one that is shared, and of each of these its longer word will do. Of the choices the one with the longest words is taken.
    """
    missing = len(grams) - math.ceil(len(grams) * least / (2 - least) - 1e-9)
    longer = sorted((max(g.split(), key=lambda w: (len(w), w)) for g in grams), key=lambda w: (-len(w), w))
    return set(longer[: missing + 1])


def hits(text: Column, templates: dict[str, str] = TEMPLATES, least: float = 0.8, unit: str = "line") -> Column:
    """array<struct<at int, licence string, dice double>>: every unit of `text` (counted from 1) and
    template whose distinct word bigrams have a Dice coefficient of `least` or more, in order of
    unit, then of template.

    A coefficient of t needs bigram counts within the factors t/(2-t) and (2-t)/t of each other, so
    a unit is compared only with templates of such a size, and units with too few or
    too many words for any template are dropped before their bigrams are made. (A unit of w words has w - 1
    bigrams at most; repeats lower that, so only the lower bound prunes on words.)
    Before that, texts without any of a few words that all matches have one of (see needed_words) are passed by.
    A null text has a null result, an empty one an empty array; a unit of one word matches nothing.
    """
    if not templates or not 0 < least <= 1:
        raise ValueError("at least one template and a threshold in (0, 1] are needed")
    known = []
    for name, wording in templates.items():
        grams = template_bigrams(wording)
        if not grams:
            raise ValueError(f"template {name} has fewer than two words")
        low, high = math.ceil(len(grams) * least / (2 - least) - 1e-9), math.floor(len(grams) * (2 - least) / least + 1e-9)
        known.append((name, grams, low, high))
    fewest = min(k[2] for k in known)
    needed = sorted({w for _, grams, *_ in known for w in needed_words(grams, least)})
    # Lower-cased once a text; that other letters are too can only let more texts through.
    marked = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in needed]))
    units = F.transform(F.split(text, UNITS[unit], -1), lambda s, i: F.struct((i + 1).alias("at"), normalised(s).alias("norm")))
    units = F.filter(units, lambda u: F.length(u["norm"]) - F.length(F.replace(u["norm"], F.lit(" "), F.lit(""))) >= fewest)

    def bigrams(norm: Column) -> Column:
        words = F.split(norm, " ", -1)
        return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    def scored(u: Column) -> Column:
        def against(name, grams, low, high):
            size = F.size(u["grams"])
            shared = F.size(F.array_intersect(u["grams"], F.array(*map(F.lit, grams))))
            dice = F.when(size.between(low, high), F.lit(2.0) * shared / (size + len(grams)))
            return F.struct(u["at"].alias("at"), F.lit(name).alias("licence"), dice.alias("dice"))

        return F.filter(F.array(*[against(*k) for k in known]), lambda h: h["dice"] >= least)

    most = max(k[3] for k in known)
    with_grams = F.transform(units, lambda u: F.struct(u["at"].alias("at"), bigrams(u["norm"]).alias("grams")))
    fitting = F.filter(with_grams, lambda u: F.size(u["grams"]).between(fewest, most))
    found = F.flatten(F.transform(fitting, scored))
    none = F.array().cast("array<struct<at:int,licence:string,dice:double>>")
    return F.when(text.isNull(), F.lit(None)).when(marked, found).otherwise(none)


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = 0.8, unit: str = "line") -> DataFrame:
    """`docs` with licence_hits (see `hits`; empty for a null text), replacing a column of that name.

    A projection: no shuffle, one row per input row, repeated rows and clashing names kept.
    """
    return docs.withColumn("licence_hits", F.coalesce(hits(F.col(text), templates, least, unit), F.array().cast("array<struct<at:int,licence:string,dice:double>>")))


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """Licence notices of all documents: number of hits, licences by name, best Dice coefficient and first line with a hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.col("licence_hits")
    return scan(docs).select(
        "doc_id", F.size(h).alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["licence"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform(h, lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
        F.coalesce(F.array_min(F.transform(h, lambda x: x["at"])), F.lit(0)).alias("first_line"),
    )


def op10_sql(templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> str:
    """The same in DuckDB, comparing every line with every template."""
    quoted = ", ".join(f"('{name}', {[*template_bigrams(t)]!r})" for name, t in templates.items())
    return f"""
with templates(licence, tgrams) as (values {quoted}),
lines as (
  select doc_id, i, string_split(trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
grams as (select doc_id, i, list_distinct([w[j] || ' ' || w[j + 1] for j in range(1, len(w))]) as g from lines where len(w) > 1),
scored as (
  select doc_id, i, licence, cast(2.0 as double) * len(list_intersect(g, tgrams)) / (len(g) + len(tgrams)) as dice
  from grams, templates),
found as (
  select doc_id, count(*) as n, string_agg(distinct licence, ',' order by licence) as l, max(dice) as d, min(i) as f
  from scored where dice >= {least} group by doc_id)
select doc_id, cast(coalesce(n, 0) as integer) as n_hits, coalesce(l, '') as licences, coalesce(d, 0.0) as best_dice, cast(coalesce(f, 0) as integer) as first_line
from documents left join found using (doc_id)"""
