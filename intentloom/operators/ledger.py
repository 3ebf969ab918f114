"""The ledger of stored keys: partitioned by a prefix of the key, read by the prefixes that a run hits, and compacted."""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.operators.identity import first_wins_dedup, ledger_anti_join
from intentloom.session import delete, has_files, work_folder

#: Letters of the key that name its partition, unless a ledger is made with other ones; keys are hexadecimal, so two letters are 256 partitions.
PREFIX = 2
#: A partition of more files than this is written anew by compaction.
FILES = 16


def _parts(key: str, prefix: int | None) -> Column:
    return F.coalesce(F.nullif(F.substring(F.col(key), 1, PREFIX if prefix is None else prefix), F.lit("")), F.lit("_"))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The whole ledger, with its partition as column `prefix`; None before anything was stored."""
    if not has_files(spark, path):
        return None
    return spark.read.option("basePath", path).schema(_schema(spark, path)).parquet(path)


def known(frame: DataFrame, path: str, key: str = "lead_id", prefix: int | None = None) -> DataFrame | None:
    """The ledger's rows in the partitions that keys of `frame` fall into; None before anything was stored.

    The prefixes of a run, at most 16 to the power of their letters, are collected and become a filter on the partition, so that a small run lists and reads its own partitions only.
    """
    found = read(frame.sparkSession, path)
    if found is None:
        return None
    hit = sorted(r[0] for r in frame.select(_parts(key, prefix)).distinct().collect())
    return found.where(F.col("prefix").isin(hit) if hit else F.lit(False))


def _schema(spark: SparkSession, path: str):
    """The ledger's columns, with prefixes as strings, whatever they look like."""
    kinds = spark.read.option("basePath", path).parquet(path).schema
    return T.StructType([T.StructField("prefix", T.StringType()) if f.name == "prefix" else f for f in kinds.fields])


def append(frame: DataFrame, path: str, key: str = "lead_id", order: Column | None = None, prefix: int | None = None, **tags: str | int | datetime) -> DataFrame:
    """Stores the rows of `frame` whose key the ledger at `path` lacks, tagged by constant columns, and returns the ledger's rows with these tags.

    Of rows that repeat a key the first by `order` stays (else the least row by all its columns), so that a rerun stores the same. A run that broke off is run again under its tags: what it had stored
    is found, the rest is added. A ledger is always given the `prefix` that it was made with. A null key is never found stored. Rows move by prefix before they are written: a file per partition hit and run.
    """
    spark = frame.sparkSession
    recover(spark, path)
    first = first_wins_dedup(frame, key, order if order is not None else F.struct(*[F.to_json(F.struct(F.col(c))) for c in frame.columns]))
    new = work_folder(spark, "new")
    first.write.parquet(new)  # made once: its prefixes and its rows are read from there
    first = spark.read.schema(first.schema).parquet(new)
    have = known(first, path, key, prefix)
    fresh = first if have is None else ledger_anti_join(first, have, key)
    for name, value in tags.items():
        fresh = fresh.withColumn(name, F.lit(value))
    fresh = fresh.withColumn("prefix", _parts(key, prefix))
    fresh.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
    delete(spark, new)
    # With its schema, as a store without rows has no file to tell it.
    mine = spark.read.schema(fresh.schema).option("basePath", path).parquet(path)
    for name, value in tags.items():
        mine = mine.where(F.col(name) == F.lit(value))
    return mine.drop("prefix")


def _staged(path: str) -> str:
    return path.rstrip("/") + "-compacting"


def _overwrite(spark: SparkSession, path: str) -> None:
    rows = read(spark, _staged(path))
    rows.repartition("prefix").sortWithinPartitions("prefix", *(["lead_id"] if "lead_id" in rows.columns else [])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    delete(spark, _staged(path))


def recover(spark: SparkSession, path: str) -> None:
    """Ends a compaction that broke off: partitions written in full beside the ledger take their place; a copy that was not finished goes."""
    if has_files(spark, f"{_staged(path)}/_SUCCESS", marker=True):
        _overwrite(spark, path)
    else:
        delete(spark, _staged(path))


def compact(spark: SparkSession, path: str, key: str = "lead_id", files: int = FILES) -> list[str]:
    """Writes partitions of more than `files` files anew as one file each, sorted by key; returns their prefixes.

    They are first written in full beside the ledger, so at any time either the old files or the whole copy are there (see recover). Nothing else may write meanwhile.
    """
    recover(spark, path)
    if not has_files(spark, path):
        return []
    found = Counter(part.split("prefix=", 1)[1].split("/", 1)[0] for part in spark.read.parquet(path).inputFiles() if "prefix=" in part)
    many = sorted(unquote(p) for p, n in found.items() if n > files)
    if many:
        rows = read(spark, path)
        rows.where(F.col("prefix").isin(many)).repartition("prefix").sortWithinPartitions("prefix", key).write.mode("overwrite").partitionBy("prefix").parquet(_staged(path))
        _overwrite(spark, path)
    return many
