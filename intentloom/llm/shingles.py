"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash and MinHash, each verified exactly.

SimHash alone cannot find them: fingerprints of texts at a similarity of 0.8 differ in some ten of 64 bits, while an index of 8 byte positions
guarantees four. So the SimHash index finds the closest pairs, and MinHash bands those down to the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common, simhash

#: Bands of the index and minima in each: a pair at similarity 0.8 shares one with probability 1 - (1 - 0.8**5)**30, or 0.999993.
BANDS, ROWS = 30, 5
#: 64-bit words of a parity map, shingles that meet all hashes at once, candidates that are broadcast (else joined).
MAP_WORDS, CHUNK, BROADCAST_ROWS = 4, 4096, 250_000
#: Open members of a bucket in one part.
PART = 2000

_RNG = np.random.default_rng(97)
_FACTOR = _RNG.integers(0, 1 << 31, (BANDS * ROWS, 1)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)
_POWERS = _RNG.integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FEATURES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("print", T.LongType()),
    *[T.StructField(f"m{i}", T.LongType()) for i in range(MAP_WORDS)], T.StructField("keys", T.ArrayType(T.LongType())),
])


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` lower-cased words; a shorter text is one shingle."""
    words = common.Words(column)
    hashes, at = words.hashes(lower=True), 0
    for n in words.sizes.tolist():
        h, k = hashes[at : at + n], min(n, width)
        at += n
        total = np.full(n - k + 1 if n else 0, k, np.uint64)
        for j in range(k):
            total += h[j : n - k + 1 + j] * _POWERS[j]
        yield np.unique(common.mixed(total))


def _features(s: np.ndarray) -> tuple:
    """Of a set of shingles: a hash of it, its size, its SimHash, its parity map, and the keys of its bands (none for an empty set)."""
    if not len(s):
        return 0, 0, 0, np.zeros(MAP_WORDS, np.int64), np.zeros(0, np.int64)
    node = common.mixed(common.mixed(s * _POWERS[8]).sum(dtype=np.uint64)[None] + np.uint64(len(s)))
    odd = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    h, least = (s >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(h), CHUNK):
        np.minimum(least, ((h[begin : begin + CHUNK] ^ _FLIP) * _FACTOR).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = common.mixed((key + column) * _POWERS[9])
    return int(node.view(np.int64)[0]), len(s), int(simhash.majority(s).view(np.int64)[0]), np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), key.view(np.int64)


def _shingled(batches: Iterator[pa.RecordBatch], width: int, text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        nodes, sizes, prints, maps, keys = zip(*map(_features, shingle_sets(batch.column(text), width)), strict=True)
        m = np.stack(maps)
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), *[pa.array(m[:, i]) for i in range(MAP_WORDS)]]
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys))))
        yield common.with_columns(batch, **{out: pa.StructArray.from_arrays(columns, names=_FEATURES.names)})


def _sets(batches: Iterator[pa.RecordBatch], width: int, text: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        found = [s.tobytes() for s in shingle_sets(batch.column(text), width)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fit = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            fit.append(both / (len(x) + len(y) - both) >= least)
        yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))


def _may_reach(least: float) -> Column:
    """Whether sizes and parity maps of nodes a and b allow `least`. No pair that reaches it fails: each shingle that
    only one of both has changes one bit of the map, so the maps differ in no more bits than the sets in shingles."""
    a, b = F.col("a.size"), F.col("b.size")
    differ = sum((F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(MAP_WORDS)), F.lit(0))
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(least) - 1e-6) & (differ <= (a + b) * F.lit((1 - least) / (1 + least)) + 1e-6)


def links(features: DataFrame, sets_of, least: float) -> DataFrame:
    """Edges (a, b) between nodes of similarity `least` or more, enough to connect all such pairs that share a band.

    `features` has one row per node; sets_of(nodes) gives node, shingles. First every node is compared with the smallest node of each of its buckets, and of
    its SimHash, as is the smallest node of a SimHash with that of the least SimHash linked to it, and takes the smallest that it is linked to as its label. Nodes of one label are connected, so only
    pairs of different labels remain, in buckets that hold some: a large group of near copies costs a
    comparison per member, not one per pair. Nothing is verified by less than both whole sets.
    """
    slim = features.drop("keys", "print")
    of = features.where("size > 0").select("print", "node")
    tops = common.stored(of.groupBy("print").agg(F.min("node").alias("center")), "tops")
    # Each fingerprint proposes the least that it is linked to, one row whatever the size of its group; what they are linked to besides is for the bands.
    near = simhash.links(tops.select(F.col("print").alias("fp"))).groupBy("b").agg(F.min("a").alias("a"))
    low, high = tops.select(F.col("print").alias("a"), F.col("center").alias("x")), tops.select(F.col("print").alias("b"), F.col("center").alias("y"))
    alike = near.join(low, "a").join(high, "b").select(F.least("x", "y").alias("center"), F.greatest("x", "y").alias("node"))
    alike = common.stored(alike.unionByName(of.join(tops, "print").where("node <> center").select("center", "node")), "alike")
    # Moved once, for the aggregate and the join.
    index = features.select("node", F.explode("keys").alias("key")).repartition("key")
    buckets = index.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    met = common.stored(index.join(buckets, "key").select("key", "node", "center"), "met")
    wanted = met.select("node").union(alike.select("node")).union(alike.select("center"))
    # Bucketed by node: pairs come to the sets, and a set only moves to meet another one.
    sets = common.bucketed(sets_of(wanted.distinct()), "node", "none", 8 * (features.agg(F.sum("size")).first()[0] or 0))

    def checked(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return common.stored(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(partial(_verified, least=least), "a long, b long"), "links")

    a, b = slim.alias("a"), slim.alias("b")
    near = met.where("node <> center").select("center", "node").unionByName(alike).distinct()
    near = near.join(b, near.node == F.col("b.node")).join(a, near.center == F.col("a.node")).where(_may_reach(least))
    first = checked(near.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    label = common.stored(first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "labels")
    top = label.select(F.col("node").alias("label"), F.col("label").alias("top"))
    label = label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    open_ = met.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = common.stored(open_, "open")
    several = open_.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / PART).alias("parts")).where("low < high").select("key", "parts")
    open_ = open_.join(several, "key").join(features, "node")
    # A bucket with many members is split: each part of it meets the whole bucket in a task of its own.
    a = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("a")
    b = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("b")
    # A pair is made in the first of its buckets only; its labels differ, so all of them are open.
    first_band = F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)) == F.col("a.key")
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.node") != F.col("a.center")) & (F.col("a.label") != F.col("b.label")) & _may_reach(least) & first_band)
    more = more.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return first.unionByName(checked(more))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of `docs`, that of the smallest id, of each group of texts connected by a Jaccard similarity of `least` or more.

    Sets hold shingles of `width` words, A-Z lower-cased; a shorter text is one shingle, and texts without words are alike.
    Of rows that repeat an id in a group the smallest by text stays; null ids come last. Rows with equal sets are one
    node, so copies never form pairs. Sets are told apart, and shingles compared, by 64-bit hashes. A pair
    right at `least` = 0.8 is found with the probability given at BANDS, a closer one more surely. Columns of any names and types pass through. An empty table stays empty.
    """
    row, near = common.fresh(docs, "row"), common.fresh(docs, "near")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    # Bucketed by row: the wanted and the surviving rows' numbers come to the texts.
    prints = common.bucketed_rows(common.mapped(numbered, partial(_shingled, width=width, out=near), text, T.StructField(near, _FEATURES)), row, common.text_bytes(docs, text))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), common.row_hash(docs).alias("row_hash"), F.col(row).alias("row"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = common.stored(wanted.join(chosen, "node"), "wanted")
        few = rows.count() <= BROADCAST_ROWS
        texts = prints.select(F.col(row).alias("row"), F.col(text).alias("text")).join(F.broadcast(rows) if few else rows, "row")
        return texts.select("node", "text").mapInArrow(partial(_sets, width=width, text="text"), "node long, shingles binary")

    nodes = common.stored(prints.select(F.col(near)["node"].alias("node"), order.alias("first")).groupBy("node").agg(F.min("first").alias("first")), "nodes")
    chosen = nodes.select("node", F.col("first.row").alias("row"))

    def survivors() -> DataFrame:
        features = prints.select(F.col(row).alias("row"), *[F.col(near)[n].alias(n) for n in _FEATURES.names if n != "node"])
        features = common.stored(features.join(chosen, "row").select(*_FEATURES.names), "features")
        edges = common.outcome(docs.sparkSession, lambda: links(features, sets_of, least), "near")
        roots = common.components(edges)
        first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        return first.select(F.col("first.row").alias(row))

    return prints.join(common.outcome(docs.sparkSession, survivors, "survivors"), row, "left_semi").select(*common.own(docs))
