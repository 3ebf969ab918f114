"""Intake: unions, caps, query catalogues and record checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentloom.functions.text import text_or_empty


def union_items(**sources: DataFrame) -> DataFrame:
    """All frames under one schema, each tagged by its keyword as `source`; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source", F.lit(n)) for n, f in sources.items()])


def cap_per_source(frame: DataFrame, by: str | list[str], order: str | list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of each group. Spark ranks and cuts before the shuffle as well as after it, so
    a large group sends at most `cap` rows per task."""
    order = [F.col(order)] if isinstance(order, str) else order
    return frame.withColumn("rank_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank_") <= cap).drop("rank_")


def query_catalog_explode(specs: DataFrame) -> DataFrame:
    """(query_idx, query, domain): one row per allowed domain; queries without domains have a null one."""
    return specs.select("query_idx", "query", F.explode_outer("domains").alias("domain"))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain_allow_filter(items: DataFrame, domains: DataFrame, url: str = "url", by: str | None = None) -> DataFrame:
    """Items whose host is a listed domain or lies under one: a semi join of the host's suffixes with the list.

    A host has a handful of suffixes (www.a.example: itself, a.example, example), so the join is by
    equality whatever the number of domains. Distinct hosts are tested, so items move once, and only by their host. With `by`, a column of both
    tables, an item is held against the domains of its own value there; values without any domain (none, or null ones) are not restricted.
    """
    keys = [by] if by else []
    found = items.withColumn("host_", host_of(F.col(url)))
    labels = F.split("host_", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = domains.where("domain is not null").select(*keys, F.lower("domain").alias("suffix_"))
    hosts = found.where("host_ is not null").select(*keys, "host_").distinct().withColumn("suffix_", F.explode(F.array_distinct(suffixes)))
    allowed = hosts.join(listed, [*keys, "suffix_"], "left_semi").select(*keys, "host_")
    kept = found.join(allowed, [*keys, "host_"], "left_semi")
    if by:
        kept = kept.unionByName(found.join(listed.select(by), by, "left_anti"))
    return kept.select(*items.columns)


def domain_allowed(url: Column, domains: list[str]) -> Column:
    """The same for a fixed list, as a predicate."""
    host = host_of(url)
    return reduce(lambda a, b: a | b, [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains], F.lit(False))


def bridge_query_select(queries: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Of every ten queries, counted from 1, the last four, if the ten are complete."""
    p = F.col(pos)
    return queries.where(((p - 1) % 10 >= 6) & (F.ceil(p / 10) * 10 <= n))


def require_fields(frame: DataFrame, *names: str) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    return frame.where(reduce(lambda a, b: a & b, [F.length(text_or_empty(F.col(n))) > 0 for n in names]))


def groups_only(groups: DataFrame) -> DataFrame:
    return groups.where(F.coalesce("is_group", F.lit(False)))
