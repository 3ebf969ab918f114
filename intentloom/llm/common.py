"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Paths and names of the tables that operators stored, by application.
_STORED: dict[str, list[tuple[str, str]]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a temporary one on a local master; elsewhere that is an error,
    as executors would not see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame, what: str, compression: str = "lz4") -> DataFrame:
    """`df` written once as a table in the shared folder and read back: later steps start
    from files that survive the loss of any executor instead of recomputing the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _STORED[spark.sparkContext.applicationId].append((path, ""))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, what: str) -> str:
    """Path of a new table in the shared folder with the rows of `df`, which `scratch` leaves alone."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def outcome(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What `make` returns as a stored table; tables that it stored on the way are dropped."""
    with scratch(spark):
        made = make()
        path, schema = kept(made, what), made.schema
        del made
    _STORED[spark.sparkContext.applicationId].append((path, ""))
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str, name: str = "") -> None:
    """Deletes a table's files, and its entry in the catalogue if it has a name."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def since(spark: SparkSession, n: int) -> list[tuple[str, str]]:
    """Path and name of the tables that operators of this session stored after the first `n`."""
    return _STORED[spark.sparkContext.applicationId][n:]


def let_go(spark: SparkSession, tables: list[tuple[str, str]], reader: DataFrame) -> None:
    """Drops stored tables that nobody needs any more, but not those that `reader` reads."""
    made = _STORED[spark.sparkContext.applicationId]
    read = reader.inputFiles() if tables else []
    for table in tables:
        place = table[0].split("://", 1)[-1].lstrip("/")
        if table in made and not any(f"/{place}/" in f for f in read):
            drop(spark, *table)
            made.remove(table)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops on leaving all tables that operators stored inside. Results that were not written by then cannot be read any more:

    with scratch(spark): pack(docs, tokenizer).write.parquet(path)
    """
    made = _STORED[spark.sparkContext.applicationId]
    before = len(made)
    try:
        yield
    finally:
        for path, name in made[before:]:
            drop(spark, path, name)
        del made[before:]
        _collect(spark)


def _collect(spark: SparkSession) -> None:
    """Spark deletes shuffles when the plans that made them are collected."""
    spark._jvm.java.lang.System.gc()


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() cuts at exactly \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(2024).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE, _CHUNK = 0xD6E8FEB86659FD93, 1 << 18


class Words:
    """All words of a text column, by place in its bytes: raw, starts, ends, and words per text (sizes)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        some = offsets[1:] > offsets[:-1]
        space = _SPACE[self.raw]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        first, last = offsets[:-1][some], offsets[1:][some] - 1
        begins[first], ends[last] = ~space[first], ~space[last]  # texts follow each other without a gap
        self.split(begins, ends)
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.sizes = np.diff(np.searchsorted(self.starts, offsets))

    def split(self, begins: np.ndarray, ends: np.ndarray) -> None:
        """For subclasses that cut words further: marks more first and last bytes."""

    def hashes(self, lower: bool = False, tail: int = 0) -> np.ndarray:
        """64-bit hashes of the words, with A-Z as a-z if `lower`; with `tail`, of the last `tail` bytes of longer words.

        Sums of byte values times powers, taken from running totals; a chunk of text at a time.
        """
        values, out = (_BYTE_LOWER if lower else _BYTE), np.empty(len(self.starts), np.uint64)
        starts = np.maximum(self.starts, self.ends - tail) if tail else self.starts
        at = 0
        while at < len(starts):
            base = starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, base + _CHUNK, "right")))
            s, e = starts[at:stop] - base, self.ends[at:stop] - base
            size = int(e[-1])
            power, inverse = powers(_BASE, max(_CHUNK, 1 << size.bit_length()))
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(values[self.raw[base : base + size]] * power[:size], out=total[1:])
            out[at:stop] = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = stop
        return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts each batch into runs of whole rows whose `column` holds about `budget` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers live on after a task


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns put at its end."""
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)


def mapped(docs: DataFrame, step: Callable, text: str, *fields: T.StructField) -> DataFrame:
    """`docs` with the columns `fields` at its end, which `step`, called with the name of the text column as text, adds to each Arrow batch.

    Columns go under plain names inside, so theirs may have dots, or clash.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*plain)
    schema = T.StructType([*inner.schema.fields, *fields])
    return inner.mapInArrow(partial(step, text=plain[docs.columns.index(text)]), schema).toDF(*docs.columns, *[f.name for f in fields])


def column(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame) -> list[Column]:
    """All columns of `df`, of whatever names."""
    return [column(c) for c in df.columns]


def _has_map(kind: T.DataType) -> bool:
    parts = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, parts))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of `df`; those with maps, which have no hash, as JSON."""
    return F.xxhash64(*[F.to_json(column(f.name)) if _has_map(f.dataType) else column(f.name) for f in df.schema.fields])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores at its end, so that `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(rows: int, each: int) -> int:
    """How many groups of about `each` rows hold `rows`."""
    return max(1, -(-int(rows) // each))


#: Edges beyond which a round's minima are a table of their own, so that the join of a hub's edges can be split.
HUB_EDGES = 1_000_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph, by alternating star contraction.

    `edges` has long columns a and b. Returns (node, root): one row per node that has an edge to
    another node, root being the smallest node of its component. Each round turns neighbours into
    direct children of the smallest neighbour, first for larger, then for smaller neighbours;
    the rounds grow with the logarithm of the component's size, and more than `rounds` are an error. Only a count and a checksum
    reach the driver; the edges of a round are a table in the shared folder. An empty graph has no rows; loops and repeated edges add nothing.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(stored(low, "minima") if seen[0] > HUB_EDGES else low, "a")

    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = star(large)
        now = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct(), "edges",
        )
        after = mark(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_components(nodes: DataFrame, roots: DataFrame, node: str, low: str) -> DataFrame:
    """(node, root, name) for every row of `nodes` (node, low): its component's root and the least `low` in it.

    Only nodes that have a root are joined with names. The names are a table of their own, so that a component with
    many nodes is a skewed partition of a plain join, which Spark splits.
    """
    own = nodes.select(F.col(node).alias("node"), F.col(low).alias("low"))
    met = stored(own.join(roots, "node", "left"), "rooted")
    bound = met.where("root is not null")
    top = roots.select(F.col("root").alias("node")).distinct()
    inner = bound.select("root", "low").union(own.join(top, "node").select(F.col("node").alias("root"), "low"))
    names = stored(inner.groupBy("root").agg(F.min("low").alias("name")), "names")
    tops = met.where("root is null").join(names.withColumnRenamed("root", "node"), "node", "left")
    tops = tops.select("node", F.col("node").alias("root"), F.coalesce("name", "low").alias("name"))
    return bound.join(names, "root").select("node", "root", "name").union(tops)


def _packed_blocks(batches: Iterator[pa.RecordBatch], text: str, budget: int) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in small_batches(batches, text, budget):
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            size = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([size]), pa.array([packed(part)], pa.binary())], names=["blk", "bytes", "payload"])
            n += 1


#: Bytes of text in a bucket of a stored table.
BUCKET_BYTES = 16_000_000


def blocks_of(docs: DataFrame, text: str = "text", budget: int = 2_000_000) -> DataFrame:
    """`docs` as a stored table of blocks: blk, bytes of text, payload (the rows as a compressed Arrow stream).

    A block holds whole rows of about `budget` bytes of text. The table is bucketed by blk, so that
    steps that bring something back to each block move that, and not the texts.
    """
    rows = docs.mapInArrow(partial(_packed_blocks, text=text, budget=budget), "blk long, bytes long, payload binary")
    return bucketed(rows, "blk", "none", text_bytes(docs, text))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bucketed(rows: DataFrame, key: str, compression: str, size: int) -> DataFrame:
    """`rows` as a stored table, bucketed by `key` into buckets of about BUCKET_BYTES of the `size` bytes of their texts, fewer bytes where
    that would leave cores without work. Rows move to their bucket before they are written, one file each."""
    spark = rows.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = max(partitions_for(size, BUCKET_BYTES), min(2 * spark.sparkContext.defaultParallelism, partitions_for(size, 1_000_000)))
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    _STORED[spark.sparkContext.applicationId].append((path, name))
    writer = rows.repartition(buckets, key).write.format("parquet").option("compression", compression).option("path", path)
    writer.bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def bucketed_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Whole rows, with columns of any names, as a stored table bucketed by their number `key` (see bucketed). They move once, here, whatever their number: what is
    chosen of them by number later comes to them. Their shuffle is deleted before later steps make theirs."""
    plain = [f"c{i}" for i in range(len(rows.columns))]
    found = bucketed(rows.toDF(*plain), plain[rows.columns.index(key)], "zstd", size).toDF(*rows.columns)
    _collect(rows.sparkSession)
    return found


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_next_batch()
