"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common
from intentloom.llm.topk import usable

#: Vectors of each dimension that rotations are learned from, entries of a table's bucket above which it is split, entries of a task's group, pairs verified at once.
SAMPLE, SPLIT, CELL, PAIRS = 4096, 512, 15_000, 100_000
#: Signs of a vector at least, those of its keys included; entries in a task's group before vectors are fetched.
SIGNS, SHORT_CELL = 128, 250_000


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Iterative quantisation: the rotation of the centred vectors x that brings them closest to their
    own signs, by turns the signs of x R and the orthogonal R nearest to them, from a seeded start. With fewer vectors than components: the start."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    start = np.linalg.qr(rng.normal(size=(d, d)))[0]
    if len(x) < d:
        return start
    _, vectors = np.linalg.eigh(x.T @ x)
    r = vectors @ start
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
        r = u @ vt
    return r


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square under- or overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class HammingTables:
    """Per dimension of vectors the rotations and the thresholds of their components, `length` of them; table t's key are signs t * bits to (t + 1) * bits.
    Pairs at the threshold of similarity differ in at most `radius` of all signs, by far."""

    rotations: dict[int, tuple[np.ndarray, np.ndarray]]
    bits: int
    tables: int
    radius: int

    @property
    def length(self) -> int:
        return max(SIGNS, self.bits * self.tables)

    @property
    def names(self) -> list[str]:
        """Columns of packed signs, 64 in each."""
        return [f"s{i}" for i in range(-(-self.length // 64))]

    def signs(self, x: np.ndarray) -> np.ndarray:
        """Signs (n, length) of unit vectors of one dimension."""
        rotation, threshold = self.rotations[x.shape[1]]
        return x @ rotation >= threshold

    def codes(self, signs: np.ndarray) -> np.ndarray:
        """Keys (n, tables)."""
        return signs[:, : self.tables * self.bits].reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))

    def packed(self, signs: np.ndarray) -> np.ndarray:
        raw = np.zeros((len(signs), 8 * len(self.names)), np.uint8)
        short = np.packbits(signs, axis=1)
        raw[:, : short.shape[1]] = short
        return raw.view("<i8")

    def unpacked(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.unpackbits(np.stack(columns, 1).astype("<i8").view(np.uint8), axis=1, count=self.length)


def tables_for(largest: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables: keys that spread the largest label over buckets of some dozens of
    vectors, and so many tables that a pair at the threshold shares one with probability `recall`, if its signs differ
    with probability angle / pi each. What is learned is measured and given more tables if it needs them."""
    bits = min(32, max(4, math.ceil(math.log2(max(2, largest))) - 6))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def learn(vectors: DataFrame, largest: int, cosine: float, recall: float, sample: int = SAMPLE) -> HammingTables:
    """Tables learned on at most `sample` unit vectors of each dimension, of small hashes; every vector is indexed later.

    Codes are balanced: components are cut at the sample's median after the rotation of its centred vectors. How often pairs right at the threshold
    (a vector of the sample and one made at that angle to it) share a key is measured, and tables are added until the share is `recall`.
    Where up to three times as many tables don't do, as with few or much alike vectors, components are cut at the origin, which has the recall of tables_for.
    """
    taken = vectors.select("embedding", F.size("embedding").alias("d"), F.xxhash64("embedding").alias("h"))
    # Of many vectors only those of small hash compete, some four times the sample, in slices that are cut before the shuffle as well.
    share = taken.groupBy(F.col("d").alias("of")).agg((F.lit(4.0 * sample + 400) / F.count("*")).alias("share"))
    taken = taken.join(share, F.col("d") == F.col("of")).where(F.pmod(F.shiftright("h", 8), F.lit(1_000_003)) <= F.col("share") * 1_000_003)
    slices = Window.partitionBy("d", F.pmod("h", F.lit(16))).orderBy("h", "embedding")
    taken = taken.withColumn("n", F.row_number().over(slices)).where(F.col("n") <= max(1, sample // 16)).orderBy("h", "embedding")
    taken = taken.select("embedding").toPandas()["embedding"]
    by_size = {d: unit(np.array([v for v in taken if len(v) == d], np.float64)) for d in sorted({len(v) for v in taken})}
    bits, tables = tables_for(largest, cosine, recall)
    rng = np.random.default_rng(17)
    pairs = {}
    for d, x in by_size.items():
        g = rng.normal(size=(min(len(x), 1000), d))
        g -= (g * x[: len(g)]).sum(1, keepdims=True) * x[: len(g)]
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-12)  # one component only: the vector itself
        pairs[d] = x[: len(g)], unit(cosine * x[: len(g)] + math.sqrt(1 - cosine * cosine) * g)
    most, centred = 3 * tables, dict.fromkeys(by_size, True)
    while True:
        index, short = HammingTables({}, bits, tables, 0), []
        for d, x in by_size.items():
            moved = x - x.mean(0) if centred[d] else x
            rotation = np.concatenate([learn_rotation(moved, seed) for seed in range(-(-index.length // d))], 1)[:, : index.length]
            index.rotations[d] = rotation, np.median(x @ rotation, 0) if centred[d] else np.zeros(index.length)
            a, b = (index.signs(v) for v in pairs[d])
            if centred[d] and (index.codes(a) == index.codes(b)).any(1).mean() < recall:
                short.append(d)
            apart = (a != b).sum(1)
            index.radius = max(index.radius, math.ceil(max(apart.max(), apart.mean() + 6 * apart.std(), index.length * (math.acos(cosine) / math.pi + 0.1))))
        if not short:
            return index
        if tables >= most:
            centred.update(dict.fromkeys(short, False))
        else:
            tables = min(most, math.ceil(tables * 1.25) + 1)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each dimension."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)


def _signs(batches: Iterator[pa.RecordBatch], index: HammingTables) -> Iterator[pa.RecordBatch]:
    """Nodes with their packed signs in place of their vectors."""
    for batch in batches:
        packed, size = np.empty((batch.num_rows, len(index.names)), "<i8"), np.empty(batch.num_rows, np.int32)
        for at, x in _matrices(batch.column("embedding")):
            size[at] = x.shape[1]
            for i in range(0, len(at), 1000):
                packed[at[i : i + 1000]] = index.packed(index.signs(unit(x[i : i + 1000])))
        arrays = [batch.column("node"), batch.column("label"), pa.array(size), *[pa.array(np.ascontiguousarray(c)) for c in packed.T]]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "label", "d", *index.names])


def _entries(batches: Iterator[pa.RecordBatch], index: HammingTables, full: bool) -> Iterator[pa.RecordBatch]:
    """Index entries: one per node and table, with its key; with `full` also node, table and signs."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 5000):
            part = batch.slice(begin, 5000)
            label, d = part.column("label").to_numpy(), part.column("d").to_numpy()
            codes = index.codes(index.unpacked([part.column(n).to_numpy() for n in index.names]))
            keys = _mix(codes + (np.arange(index.tables) << 40), label[:, None], d[:, None])
            columns = {"key": pa.array(keys.ravel())}
            if full:
                columns["tbl"] = pa.array(np.tile(np.arange(index.tables, dtype=np.int32), len(codes)))
                columns |= {n: pa.array(np.repeat(part.column(n).to_numpy(), index.tables)) for n in ("node", *index.names)}
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def _mix(codes: np.ndarray, label: np.ndarray, d: np.ndarray) -> np.ndarray:
    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + label.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + d.astype(np.uint64)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place that each of n places reaches over the links a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _runs(key: np.ndarray, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs to compare in a group of bucket parts (in the order of key, a and b), PAIRS or so at a time: within an undivided part all pairs, between two parts those across."""
    n = len(key)
    first = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [n]))
    later = np.repeat(first[1:], np.diff(first)) - np.arange(n) - 1  # entries after each in its run
    sums, at = np.cumsum(later), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        c = later[at:end]
        i = np.repeat(np.arange(at, end), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        at = end
        fit = (a[i] == b[i]) | (side[i] != side[j])
        yield i[fit], j[fit]


_PART = ["key", "a", "b", "side", "tbl", "node"]


def _close(cell: pa.Table, index: HammingTables) -> pa.Table:
    """The entries that have another one of their bucket part within the radius of all signs."""
    part = {n: cell.column(n).to_numpy() for n in _PART}
    order = np.lexsort((part["node"], part["b"], part["a"], part["key"]))
    part = {n: v[order] for n, v in part.items()}
    signs = np.stack([cell.column(n).to_numpy()[order] for n in index.names], 1).view(np.uint64)
    keep = np.zeros(len(order), bool)
    for i, j in _runs(*[part[n] for n in ("key", "a", "b", "side")]):
        fit = np.bitwise_count(signs[i] ^ signs[j]).sum(1) <= index.radius
        keep[i[fit]] = keep[j[fit]] = True
    return cell.take(pa.array(order[keep])).select([*_PART, *index.names])


def _linked(cell: pd.DataFrame, cosine: float, index: HammingTables) -> pd.DataFrame:
    """Links of a group of bucket parts: per vector its linked vectors (links) and edges that connect what links connect."""
    cell = cell.sort_values(["key", "a", "b", "node"], kind="stable").reset_index(drop=True)
    label, tbl = cell["label"].to_numpy(np.int64), cell["tbl"].to_numpy(np.int64)
    node, place = np.unique(cell["node"].to_numpy(np.int64), return_inverse=True)
    codes = index.codes(index.unpacked([cell[n].to_numpy(np.int64) for n in index.names]))
    size = cell["embedding"].map(len).to_numpy()
    x = np.zeros((len(cell), int(size.max())))
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x[at, :d] = unit(np.stack(cell["embedding"].to_numpy()[at]).astype(np.float64))
    copies = cell["copies"].to_numpy(np.float64)
    links, edges = np.zeros(len(node)), []
    for i, j in _runs(*[cell[n].to_numpy(np.int64) for n in ("key", "a", "b", "side")]):
        fit = (label[i] == label[j]) & (size[i] == size[j])
        i, j = i[fit], j[fit]
        # A pair belongs to the first table that its codes share.
        fit = ~((codes[i] == codes[j]) & (np.arange(index.tables) < tbl[i][:, None])).any(1) & (codes[i, tbl[i]] == codes[j, tbl[j]])
        i, j = i[fit], j[fit]
        fit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[fit], j[fit]
        links += np.bincount(place[i], copies[j], len(node)) + np.bincount(place[j], copies[i], len(node))
        if len(i):
            low = _least(place[i], place[j], len(node))
            moved = np.flatnonzero(low != np.arange(len(node)))
            edges.append(np.stack([moved, low[moved]]))
    pairs = np.unique(np.concatenate(edges, 1), axis=1) if edges else np.zeros((2, 0), np.int64)
    some = np.flatnonzero(links)
    return pd.DataFrame({
        "node": np.concatenate([node[some], node[pairs[0]]]), "links": np.concatenate([links[some].astype(np.int64), np.zeros(pairs.shape[1], np.int64)]),
        "root": pd.array([None] * len(some) + node[pairs[1]].tolist(), "Int64"),
    })


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.98) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of one label with equal vectors are one node, counted by its copies. A node is entered in Hamming tables by its
    balanced codes, an entry being a key, the node and its signs. Entries that have no other one of their bucket near in all signs
    are dropped; for the others the original vectors are fetched, and nodes that share a bucket are compared by cosine in double precision, each
    pair in the first table it shares only. Its link is counted at both ends, so that no pair of a
    group of copies leaves the task that found it. Buckets over SPLIT entries are cut into parts that
    meet two by two in tasks of their own. `recall` is the probability that a pair right at the threshold meets;
    closer pairs meet more surely.
    Null labels, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing. Labels may be of any type that has
    equality; other than integers are told by a 64-bit hash. Vectors of different dimension don't link. A
    repeated vec_id keeps its rows; an empty table gives no rows. Other columns don't take part.
    """
    kind = vectors.schema["label"].dataType
    label = F.col("label").cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    most = F.aggregate("embedding", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v.cast("double"))))
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    marked = vectors.withColumn("fit", F.when(fit, most > 0).otherwise(F.lit(False)))
    alone = marked.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Equal vectors have equal pairs of hashes; with these, what is found goes back to rows without their vectors.
    hashes = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding", F.lit(7)).alias("h2")]
    good = marked.where("fit").select("vec_id", "label", *hashes)
    nodes = marked.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    nodes = common.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    if not largest[0]:
        return alone
    index = learn(nodes, largest[0], cosine, recall)
    words = ", ".join(f"{n} long" for n in index.names)
    signed = nodes.select("label", "node", "embedding").mapInArrow(partial(_signs, index=index), f"node long, label long, d int, {words}")
    signed = common.stored(signed, "signs")
    counts = signed.mapInArrow(partial(_entries, index=index, full=False), "key long").groupBy("key").count()
    hot = common.stored(counts.where(F.col("count") > SPLIT).select("key", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts")), "hot")
    more = hot.agg(F.sum(F.col("parts") * F.col("parts") * SPLIT)).first()[0] or 0
    entries = signed.mapInArrow(partial(_entries, index=index, full=True), f"key long, tbl int, node long, {words}")
    entries = entries.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    entries = entries.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))

    def cell(rows: int, each: int) -> Column:
        return F.pmod(F.xxhash64("key", "a", "b"), F.lit(common.partitions_for(rows, each))).alias("cell")

    def close_of(part: pa.Table) -> pa.Table:
        return _close(part, index)

    def links_of(part):
        return _linked(part, cosine, index)

    entries = entries.select(cell(largest[1] * index.tables + more, SHORT_CELL), *_PART, *index.names)
    close = entries.groupBy("cell").applyInArrow(close_of, f"key long, a int, b int, side int, tbl int, node long, {words}")
    close = common.stored(close, "close")
    met = close.select(cell(close.count(), CELL), "*").join(nodes.select("node", "label", "copies", "embedding"), "node")
    found = common.stored(met.groupBy("cell").applyInPandas(links_of, "node long, links long, root long"), "links")
    roots = common.components(found.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = common.named_components(nodes, roots, "node", "low").select("node", F.col("name").alias("component_id"))
    full = nodes.select("node", "label", "copies", *hashes).join(degree, "node", "left").join(named, "node")
    full = full.select("label", "h1", "h2", (F.coalesce(F.col("links"), F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = good.join(full, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
