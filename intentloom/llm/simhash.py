"""SimHash near-duplicates through an inverted index over byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common

#: Bytes of a fingerprint, entries of one choice of positions in a cell, fingerprints per task that makes entries, members up to which a
#: posting is compared pair by pair, pairs compared at once.
BYTES, CELL, SPREAD, SMALL, PAIRS = 8, 250_000, 20_000, 64, 500_000


def fingerprint(words: list[bytes], width: int, seed: int = 42, chunk: int = 100_000) -> int:
    """64-bit SimHash of the words' shingles; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(text[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    return int(majority(hashes, chunk)[0])


def majority(hashes: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """The 64-bit SimHash (as an array of one) of 64-bit hashes: bits that are set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        bits = np.unpackbits(hashes[at : at + chunk].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of 255 bits stay in a byte
            counts += bits[row : row + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int, text: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in common.small_batches(batches, text):
        found = [fingerprint([w.lower() for w in common.words_of(t)] if t else [], width) for t in batch.column(text).to_pylist()]
        yield common.with_columns(batch, **{out: pa.array(np.array(found, np.uint64).view(np.int64))})


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", width: int = 4) -> DataFrame:
    """`docs` with the signed 64-bit fingerprint of each whole text in column `out`, replacing a column of that name; 0 for null texts and those without words."""
    return common.mapped(docs.drop(out), partial(_fingerprints, width=width, out=out), text, T.StructField(out, T.LongType()))


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of their 8 positional bytes two fingerprints share."""
    return (np.ascontiguousarray(a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def retained(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which of the pairs that met share `least` or more positional bytes: the count filter."""
    return np.flatnonzero(tally(a, b) >= least)


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs stay: those that share the guaranteed number of bytes, and of these the ones at most `max_bits` apart."""
    fit = retained(a, b, BYTES - max_bits)
    out = np.zeros(len(a), bool)
    out[fit] = np.bitwise_count(a[fit] ^ b[fit]) <= max_bits
    return out


@lru_cache
def positions(max_bits: int) -> list[tuple[int, ...]]:
    """Choices of one byte position less than a fitting pair must share, such that any positions that it shares include one of them.

    Chosen greedily, those that stand for most sets of shared positions first; for pairs of 4 bits, where 4 bytes are shared, some twenty of the 56 threes will do.
    """
    shared = 8 - max_bits
    open_ = set(combinations(range(BYTES), shared))
    choices, out = list(combinations(range(BYTES), shared - 1)), []
    while open_:
        best = max(choices, key=lambda c: (sum(set(c) <= set(s) for s in open_), c))
        out.append(best)
        open_ = {s for s in open_ if not set(best) <= set(s)}
    return out


def _posted(batches: Iterator[pa.RecordBatch], masks: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints under every choice of positions: one row per cell with the fingerprints whose bytes there fall into it."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for k, mask in enumerate(masks):
            part = (common.mixed((fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            rows = [(int(part[p[0]]), fp[p].tobytes()) for p in np.split(order, edges) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([k * parts + c for c, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], names=["cell", "fps"])


def _spanning(fp: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Links (2, n) that connect what all links among one posting's fingerprints connect: breadth first, each
    fingerprint being compared with those that no one has reached yet. Near copies fall away at once."""
    out, left = [], fp
    while len(left):
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            at = todo.pop()
            for one in at:
                found = near(np.full(len(left), one), left, max_bits)
                if found.any():
                    reached, left = left[found], left[~found]
                    todo.append(reached)
                    out.append(np.stack([np.full(len(reached), one), reached]))
    return out


def _linked(table: pa.Table, masks: list[int], parts: int, max_bits: int) -> pa.Table:
    """Edges of a cell. Postings are runs of fingerprints with equal bytes at the cell's positions."""
    fp = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
    key = fp & np.uint64(masks[table.column("cell")[0].as_py() // parts])
    order = np.argsort(key, kind="stable")
    fp, key = fp[order], key[order]
    starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(fp)))
    out = [np.zeros((2, 0), np.uint64)]
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += _spanning(fp[at : at + n], max_bits)
    small = np.repeat(sizes <= SMALL, sizes)
    later = np.where(small, np.repeat(starts + sizes, sizes) - np.arange(len(fp)) - 1, 0)
    sums, at = np.cumsum(later), 0
    while at < len(fp):  # pairs of small postings, some at a time
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        c = later[at:stop]
        i = np.repeat(np.arange(at, stop), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        fit = near(fp[i], fp[j], max_bits)
        out.append(np.stack([fp[i[fit]], fp[j[fit]]]))
        at = stop
    edges = np.concatenate(out, 1).view(np.int64)
    edges = np.unique(np.sort(edges, 0), axis=1)
    return pa.table({"a": edges[0], "b": edges[1]})


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (a, b), a < b, between fingerprints (column fp) at most `max_bits` apart, enough to connect all that such pairs connect.

    Two fingerprints that differ in d bits differ in d bytes at most, so they share at least 8 - d of their 8 positional
    bytes. The index has postings for the bytes at choices of one position less (see positions), in one of which every such pair meets, and others do too. Where a
    pair meets, all positional bytes that it shares are tallied; it stays if they reach the
    guaranteed number, and is then verified by its Hamming distance. Postings come packed, CELL entries or so of one choice of positions in a
    task; small ones are compared pair by pair, larger ones breadth first, and only edges leave the task. `max_bits` from 2
    to 6 are indexed, others are a ValueError. Repeated fingerprints count once; none give no edges.
    """
    if not 2 <= max_bits <= 6:
        raise ValueError("max_bits must be between 2 and 6")
    masks = [sum(0xFF << 8 * j for j in c) for c in positions(max_bits)]
    prints = common.stored(prints.select("fp").distinct(), "prints")
    n = prints.count()
    parts = common.partitions_for(n, CELL)
    spread = prints.repartition(common.partitions_for(n, SPREAD), "fp")
    cells = spread.mapInArrow(partial(_posted, masks=masks, parts=parts), "cell long, fps binary")

    def linked(cell: pa.Table) -> pa.Table:
        return _linked(cell, masks, parts, max_bits)

    return cells.groupBy("cell").applyInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """`docs` with columns simhash (long) and component_id, the smallest id reachable over links.

    Rows with equal fingerprints are one node, so copies never form pairs. A null or empty text has
    fingerprint 0 and is linked like any other; texts shorter than a shingle hash their whole word
    sequence. Repeated rows and repeated ids keep their rows; null ids never name a component
    unless it has no other. Other columns pass through; input columns named simhash or component_id
    are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("simhash", "component_id")
    prints = common.stored(with_fingerprints(docs, text, "simhash", width), "fingerprints", "zstd")
    return prints.join(_members(prints, doc_id, max_bits), "simhash").select(*common.own(docs), "simhash", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """The id, simhash and component_id of every row, as near_duplicates gives them, without keeping the texts."""
    prints = common.stored(with_fingerprints(docs.select(doc_id, text), text, "simhash", width).select(doc_id, "simhash"), "fingerprints")
    return prints.join(_members(prints, doc_id, max_bits), "simhash").select(doc_id, "simhash", "component_id")


def _members(prints: DataFrame, doc_id: str, max_bits: int) -> DataFrame:
    """(simhash, component_id) for every fingerprint of `prints`."""
    return _rooted(prints, doc_id, max_bits).drop("root")


def _rooted(prints: DataFrame, doc_id: str, max_bits: int) -> DataFrame:
    """(simhash, root, component_id) for every fingerprint of `prints`; root, a fingerprint, is the component's key, which its id need not be."""
    nodes = prints.groupBy(F.col("simhash").alias("fp")).agg(F.min(doc_id).alias("low"))
    nodes = common.stored(nodes, "nodes")
    roots = common.components(links(nodes.select("fp"), max_bits))
    return common.named_components(nodes, roots, "fp", "low").select(F.col("node").alias("simhash"), "root", F.col("name").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4, least: float | None = None) -> DataFrame:
    """One row of `docs` of each near-duplicate group: of fingerprints linked at `max_bits` or fewer bits or, with `least`, of texts connected by
    a Jaccard similarity of `least` or more of their shingles (see shingles.one_of_each, which has this index propose pairs and finds those that
    lie too far apart for it).

    Of fingerprints, the row stays whose id names the group; of rows that repeat the naming id one is kept (the smallest by text); a group of null ids keeps one row.
    Other groups of the same id, or of null ids, keep theirs. Texts without words are alike. Columns of any names and types pass through; an empty table stays empty.
    """
    if least is not None:
        from intentloom.llm import shingles

        return shingles.one_of_each(docs, doc_id, text, width, least)
    row, print_ = common.fresh(docs, "row"), common.fresh(docs, "simhash")
    # Rows are chosen by numbers; whole rows move once, to be stored by number, and the choice comes to them.
    prints = common.bucketed_rows(with_fingerprints(docs.withColumn(row, F.monotonically_increasing_id()), text, print_, width), row, common.text_bytes(docs, text))
    order = F.struct(F.xxhash64(text).alias("text_hash"), common.row_hash(docs).alias("row_hash"), F.col(row).alias("row"))
    slim = prints.select(order.alias("first"), F.col(doc_id).alias("id"), F.col(print_).alias("simhash"))
    named = slim.join(_rooted(slim, "id", max_bits), "simhash").where(F.col("id").eqNullSafe(F.col("component_id")))
    first = named.groupBy("root").agg(F.min("first").alias("first"))
    return prints.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*common.own(docs))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by SimHash."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
