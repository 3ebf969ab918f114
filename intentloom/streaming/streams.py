"""Structured Streaming forms of the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from intentloom.operators import ledger


def read_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet file or files at `path`, with the schema they have now.

    The path is given as a pattern that only it matches, as a plain one must be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there, writes parquet and reads it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stream_dedup(events: DataFrame, keys: list[str], when: str = "ts", horizon: str = "24 hours") -> DataFrame:
    """First sight of each key within the horizon; state of older keys is dropped by the watermark."""
    return events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, horizon).dropDuplicatesWithinWatermark(keys)


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _given_out(rows: pd.DataFrame, span: int, passed: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sights (key_, micros_) to give out, and the rows that stay, of rows (key_, micros_, given_): last sights given out (given_) and waiting times."""
    due = rows[rows["given_"] | (rows["micros_"] < passed)]
    code, names = pd.factorize(due["key_"])
    micros, given = due["micros_"].to_numpy(np.int64), due["given_"].to_numpy(bool)
    order = np.lexsort((micros, ~given, code))
    out, last = [], {}
    for i, c, t, old in zip(order.tolist(), code[order].tolist(), micros[order].tolist(), given[order].tolist(), strict=True):
        if old or c not in last or t >= last[c] + span:
            last[c] = t
            if not old:
                out.append(i)
    kept = [(c, t) for c, t in last.items() if t + span > passed]
    held = pd.DataFrame({"key_": names.take([c for c, _ in kept]), "micros_": np.array([t for _, t in kept], np.int64), "given_": True})
    return due.iloc[out][["key_", "micros_"]], pd.concat([rows[~rows["given_"] & (rows["micros_"] >= passed)], held], ignore_index=True)


def stream_first_sights(events: DataFrame, keys: list[str], when: str = "ts", horizon: str = "24 hours", late: str = "24 hours", buckets: int = 256) -> DataFrame:
    """(keys, when): each sight of a key that comes `horizon` or more after the last one given out, the first one included.

    That is decided in the order of event time, whatever the order of arrival: times wait in the state until the watermark, `late` behind the newest event, has passed them, so the result is that of the whole
    history sorted, for rows less than `late` behind. State has the last sight and the waiting times of each key; a timer gives out what waits, and drops keys whose horizon has passed.
    A group of the state holds all keys of one of `buckets` hashes, so that a batch costs a call per bucket and not one per key; a checkpoint keeps the number that it was made with, and many
    millions of live keys want more buckets. Null times are left out.
    """
    span = int(pd.Timedelta(horizon) / pd.Timedelta(microseconds=1))
    timed = events.where(F.col(when).isNotNull()).select(*keys, F.col(when).cast("timestamp").alias(when)).withWatermark(when, late)
    # A key is told by its JSON, which pandas leaves as it is; nulls in a column of numbers would make them floats.
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows = timed.select(when, F.to_json(F.struct(*keys), form).alias("key_"), F.unix_micros(when).alias("micros_")).withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(buckets)))

    def sights(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(pa.py_buffer(bytes(state.get[0]))).read_pandas()] if state.exists else []
        new = [] if state.hasTimedOut else [b[["key_", "micros_"]].assign(given_=False) for b in batches]
        passed = state.getCurrentWatermarkMs() * 1000
        out, rest = _given_out(pd.concat([*held, *new], ignore_index=True), span, passed)
        if len(rest):
            state.update((_packed(rest),))
            state.setTimeoutTimestamp(max(passed, int((rest["micros_"] + rest["given_"] * span).min())) // 1000 + 1)
        else:
            state.remove()
        if len(out):
            yield out

    found = rows.groupBy("bucket_").applyInPandasWithState(sights, "key_ string, micros_ long", "rows binary", "append", "EventTimeTimeout")
    told = F.from_json("key_", T.StructType([events.schema[k] for k in keys]), form)
    return found.select(told.alias("key_"), F.timestamp_micros("micros_").alias(when)).select(*[F.col("key_")[k].alias(k) for k in keys], when)


def stream_counts(events: DataFrame, by: str, when: str = "ts", width: str = "1 day", late: str = "24 hours") -> DataFrame:
    """Rows per tumbling window and key, given out once the watermark has passed the window."""
    timed = events.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return timed.groupBy(F.window(when, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), by, "n")


def stream_ledger(stream: DataFrame, path: str, checkpoint: str, key: str = "lead_id", order: Column | None = None, prefix: int | None = None) -> None:
    """Insert-if-absent of a stream into the ledger at `path`.

    Each micro-batch reads the partitions that its keys fall into and appends what they lack, tagged by its id. A batch that is run again after a failure
    finds what it had stored and adds the rest. Of rows with one key in a batch the first by `order` stays.
    """

    def insert(batch: DataFrame, batch_id: int) -> None:
        ledger.append(batch, path, key, order, prefix, batch_id=batch_id)

    stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_score(items: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str] | None = None, when: str = "ts", horizon: str = "24 hours") -> DataFrame:
    """The batch scoring of items, applied to a stream of them. With `keys`, only the first item of each key within the
    horizon is scored: copies go before the scoring, as they do in a batch."""
    return score(stream_dedup(items, keys, when, horizon) if keys else items)
