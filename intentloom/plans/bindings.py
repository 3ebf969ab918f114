"""The test tables as the library's records, and pieces of SQL for their oracles."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
FOUND_AT = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items, met in the order of doc_id by 33 queries in turn."""
    return table(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.lit("").alias("title"), "text",
        F.lit(None).cast("string").alias("published"), F.lit("").alias("author"), (F.col("doc_id") % 33 + 1).cast("int").alias("query_idx"),
        F.col("doc_id").cast("int").alias("pos"), "doc_id",
    )


ITEMS_SQL = """items as (select source, 'doc://' || doc_id as url, '' as title, text, '' as author, doc_id, doc_id % 33 + 1 as query_idx, doc_id as pos,
  lower('' || ' ' || coalesce(text, '')) as blob from documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: the group is named by role, a minute lies between conversations; some name a sum."""
    c = F.col
    sums = F.when((c("conv_id") % 5 == 0) & (c("turn") % 2 == 0), F.concat(F.lit(" up to "), c("conv_id").cast("string"), F.lit("k"))).when(c("conv_id") % 7 == 0, F.concat(F.lit(" £"), c("conv_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", sums)).select(
        c("conv_id").alias("group_id"), c("role").alias("group"), F.when(c("role") == "user", c("role")).alias("group_username"), c("turn").alias("message_id"), "text",
        F.timestamp_seconds(F.lit(1704067200) + c("conv_id") * 60 + c("turn")).alias("date"),
        F.struct(F.when(c("role") == "user", F.concat(F.lit("u"), c("conv_id").cast("string"))).alias("username"), c("role").alias("first_name"), c("conv_id").cast("string").alias("last_name")).alias("sender"),
    )


#: The conversations' texts, some of which name a sum.
TEXT_SQL = "(text || case when conv_id % 5 = 0 and turn % 2 = 0 then ' up to ' || conv_id || 'k' when conv_id % 7 = 0 then ' £' || conv_id else '' end)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(blob: str, phrases: Iterable[str]) -> str:
    return "(" + " + ".join([f"cast(contains({blob}, {quoted(p.lower())}) as integer)" for p in phrases] or ["0"]) + ")"


def any_sql(blob: str, phrases: Iterable[str]) -> str:
    return "(" + " or ".join([f"contains({blob}, {quoted(p.lower())})" for p in phrases] or ["false"]) + ")"


def market_sql(blob: str, gazetteer) -> str:
    return "case " + " ".join(f"when {any_sql(blob, terms)} then {quoted(m)}" for m, terms in gazetteer) + " else 'unknown' end"


def folded_sql(c: str) -> str:
    """Folding of the letters that the test tables have: lower case, and the sharp s and other sigma."""
    out = f"lower(coalesce({c}, ''))"
    for a, b in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def matches_sql(folded: str, patterns) -> str:
    """Matches of whole words as a list; a word's neighbours are no letters, digits or underscores."""
    words = [p.core for p in patterns]
    return "list_filter([" + ", ".join(f"case when regexp_matches({folded}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') then '{w}' else '' end" for w in words) + "], lambda x: x <> '')" if words else "cast([] as varchar[])"
