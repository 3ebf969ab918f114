"""Identity of records: fingerprints, first-wins dedup, ledger checks and windows of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentloom.functions.scoring import group_priority
from intentloom.functions.text import fold_text, text_or_empty


def fingerprint(url: Column, title: Column, author: Column) -> Column:
    """sha256 of the lower-cased url, title and author, joined by a vertical bar."""
    return F.sha2(F.lower(F.concat_ws("|", *map(text_or_empty, (url, title, author)))), 256)


def message_key(tag: str, group_id: Column, message_id: Column) -> Column:
    """sha256 of source tag, group and message id, joined by a vertical bar."""
    return F.sha2(F.concat_ws("|", F.lit(tag), group_id.cast("string"), message_id.cast("string")), 256)


def arrival(query_idx: Column, source_ord: Column, pos: Column) -> Column:
    """Order in which a run meets items: batches of ten queries, search hits before news, query, position."""
    return F.struct(F.ceil(query_idx / 10).alias("batch"), source_ord.alias("source_ord"), query_idx.alias("query_idx"), pos.alias("pos"))


def first_wins_dedup(frame: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key in the given order.

    A minimum per key rather than a ranking: rows are combined before the shuffle, so one key with a third of
    all rows sends one row per task.
    """
    whole = F.struct(*[F.col(c) for c in frame.columns])
    return frame.groupBy(F.col(key).alias("key_")).agg(F.min_by(whole, order).alias("row_")).select("row_.*")


def ledger_anti_join(frame: DataFrame, ledger: DataFrame, key: str = "lead_id") -> DataFrame:
    """Rows whose key is not recorded yet; the ledger may repeat keys."""
    return frame.join(ledger.select(key), key, "left_anti")


def window_cutoff(frame: DataFrame, when: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows no older than `hours` before as_of; pushed to the scan as a comparison with a constant."""
    return frame.where(F.col(when) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))


def latest_n_per_group(frame: DataFrame, group: str, when: list[Column], n: int = 500, rank: str | None = None) -> DataFrame:
    """The newest n rows of each group, ranked before any other filter; cut before the shuffle as well. The rank, from 1, is kept as column `rank`, if that is given."""
    ranked = frame.withColumn(rank or "rank_", F.row_number().over(Window.partitionBy(group).orderBy(*when))).where(F.col(rank or "rank_") <= n)
    return ranked if rank else ranked.drop("rank_")


def group_order(groups: DataFrame, name: str, username: str, high: tuple[str, ...], medium: tuple[str, ...]) -> DataFrame:
    """Groups by priority of their name (else username), then by folded name."""
    known = F.coalesce(F.nullif(F.col(name), F.lit("")), F.nullif(F.col(username), F.lit("")), F.lit(""))
    priority = group_priority(known, high, medium)
    rank = F.when(priority == "HIGH", 0).when(priority == "MEDIUM", 1).otherwise(2)
    return groups.withColumn("priority_rank", rank).withColumn("folded_name", fold_text(F.col(name))).orderBy("priority_rank", "folded_name")
