"""Counts of a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intentloom.functions.text import text_or_empty
from intentloom.operators.identity import fingerprint


def source_counts(frame: DataFrame, source: str = "source") -> DataFrame:
    return frame.groupBy(source).agg(F.count("*").alias("n"))


def unique_results(items: DataFrame) -> DataFrame:
    """Distinct fingerprints among items with a url."""
    known = items.where(F.length(text_or_empty(F.col("url"))) > 0)
    return known.agg(F.count_distinct(fingerprint(F.col("url"), F.col("title"), F.col("author"))).alias("unique_results"))


#: Logarithm of the buckets of a sketch of distinct results: an error of about 1 % of the count.
SKETCH = 14


def unique_sketch(items: DataFrame) -> DataFrame:
    """One row with unique_sketch: a mergeable sketch of the fingerprints among items with a url, to be kept in the scan log."""
    known = items.where(F.length(text_or_empty(F.col("url"))) > 0)
    return known.agg(F.hll_sketch_agg(fingerprint(F.col("url"), F.col("title"), F.col("author")), F.lit(SKETCH)).alias("unique_sketch"))


def unique_over_runs(log: DataFrame) -> DataFrame:
    """About how many distinct results the runs of a scan log have had together, from their sketches alone: no items are read."""
    return log.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("unique_sketch")), F.lit(0).cast("long")).alias("unique_results"))


def new_lead_counts(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count("*").alias("new_hot_warm"))


def chat_counts(messages: DataFrame, is_lead: Column) -> DataFrame:
    """Groups, messages and leads in one pass."""
    return messages.agg(F.count_distinct("group_id").alias("chat_groups"), F.count("*").alias("chat_messages"), F.count_if(is_lead).alias("chat_leads"))


def error_counts(frame: DataFrame, source: str, failed: Column) -> DataFrame:
    """Rows per source that failed to parse; sources without failures count 0."""
    return frame.groupBy(source).agg(F.count_if(failed).alias("errors"))


def failure_counts(failures: DataFrame, source: str = "source", errors: str = "errors") -> DataFrame:
    """One row from failures per source: errors (their sum) and source_errors (a map; one entry per source)."""
    total = failures.agg(F.coalesce(F.sum(errors), F.lit(0)).cast("long").alias("errors"))
    per = failures.groupBy(source).agg(F.sum(errors).cast("long").alias("source_errors"))
    return total.withColumn("k_", F.lit(1)).join(counts_map(per, source, "source_errors").withColumn("k_", F.lit(1)), "k_").drop("k_")


def counts_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Counts per key as one map, keys in order; one entry per source."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(key, F.lit("")), value)))).alias(value))


def scan_summary(started: datetime, completed: datetime, queries: int, chat_status: str = "completed", results_per_query: int | None = None, quality_gate: str | None = None, **parts: DataFrame) -> DataFrame:
    """One row for the run: each part is a frame of one row, whose columns are put side by side. The results asked for per query and the name of the gates are told if given."""
    out = None
    for part in parts.values():
        part = part.withColumn("one_", F.lit(1))
        out = part if out is None else out.join(part, "one_")
    return out.drop("one_").select(
        F.lit(started.strftime("%Y%m%dT%H%M%SZ")).alias("scan_id"), F.lit("completed").alias("status"), F.lit(started).alias("started_at"),
        F.lit(completed).alias("completed_at"), F.lit(queries).alias("queries"),
        *([F.lit(results_per_query).alias("results_per_query")] if results_per_query is not None else []), *([F.lit(quality_gate).alias("quality_gate")] if quality_gate is not None else []), "*", F.lit(chat_status).alias("chat_status"),
    )
