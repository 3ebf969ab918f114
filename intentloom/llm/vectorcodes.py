"""Vectors as short codes: a codebook per part of the vector, learned by ball k-means over all rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intentloom.llm import common
from intentloom.llm.topk import usable

#: Entries of a codebook, parts of a vector, rounds of learning, what components are multiplied by before they are floored.
ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Vectors of a block, vectors whose distances are taken at once.
BLOCK, CHUNK = 16_384, 4096
_STATE = "rows binary, v binary, codes binary, part int, entry int, sums array<long>, radius long"
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


@dataclass
class Codebooks:
    """Integer entries of each part (entries, width)."""

    parts: list[np.ndarray]

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.parts for x in part.ravel().tolist()).encode()).hexdigest()

    def decoded(self, code: str, scale: int = SCALE) -> list[float]:
        """The middle of the cell of floored components that a code stands for."""
        index = [int(code[2 * p : 2 * p + 2], 16) for p in range(len(self.parts))]
        return [(x + 0.5) / scale for p, i in enumerate(index) for x in self.parts[p][i].tolist()]


@dataclass
class Balls:
    """A part's entries with, for each, the entries that its ball may reach, nearest first, and a quarter of their squared distances."""

    entries: np.ndarray
    near: list[np.ndarray] | None = None
    quarter: list[np.ndarray] | None = None


def largest(width: Column | float) -> Column | float:
    """Components up to which all squared distances of a vector fit a long, if a part has `width` of them."""
    return F.lit(2.0**29) / F.sqrt(width) if isinstance(width, Column) else 2.0**29 / math.sqrt(width)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows: by products in doubles where every sum stays below 2**53, else by differences of integers."""
    most = float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))
    if most * most * x.shape[1] < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, one in enumerate(c):
        out[:, j] = ((x - one) ** 2).sum(1)
    return out


def balls(entries: np.ndarray, reach: np.ndarray) -> Balls:
    """`reach`: a bound of the squared radius of each entry's ball, below 0 where it is empty.

    A member x of ball i at squared distance D can only be as near to entry j if |i - j|**2 <= 4 D: the triangle inequality,
    held in whole numbers as D >= a quarter of |i - j|**2, rounded up. So a ball's neighbours are the entries whose quarter its radius reaches.
    """
    quarter = -(-squared(entries, entries) // 4)
    near, rings = [], []
    for i, q in enumerate(quarter):
        j = np.flatnonzero(q <= reach[i])
        j = j[j != i]
        j = j[np.argsort(q[j], kind="stable")]
        near.append(j)
        rings.append(q[j])
    return Balls(entries, near, rings)


def _nearest(x: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending indexes `among`, the nearest (the lower of equals) and its squared distance for each row."""
    code, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), CHUNK):
        d = squared(x[at : at + CHUNK], entries[among])
        k = d.argmin(1)
        code[at : at + CHUNK], best[at : at + CHUNK] = among[k], d[np.arange(len(d)), k]
    return code, best


def assigned(x: np.ndarray, own: np.ndarray | None, part: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance; `own` are the entries of the round before.

    Rows in the stable core, nearer to their entry than half way to any other, stay without a comparison. The others lie in rings around
    their entry, and those within the k-th ring are held against the k nearest neighbours; rings are taken together up to powers of two.
    """
    if own is None:
        return _nearest(x, part.entries, np.arange(len(part.entries)))
    code, best = own.copy(), ((x - part.entries[own]) ** 2).sum(1)
    order = np.argsort(own, kind="stable")
    edges = np.searchsorted(own[order], np.arange(len(part.entries) + 1))
    for i in np.flatnonzero(np.diff(edges)):
        members, near = order[edges[i] : edges[i + 1]], part.near[i]
        ring = np.searchsorted(part.quarter[i], best[members], "right")
        low = 0
        while low < len(near):
            high = max(1, 2 * low)
            rows = members[(ring > low) & (ring <= high)]
            if len(rows):
                code[rows], best[rows] = _nearest(x[rows], part.entries, np.sort(np.append(near[:high], i)))
            low = high
    return code, best


def _cut(batches: Iterator[pa.RecordBatch], width: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of PARTS * width usable components, as integers, with their other columns packed."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            vectors = rows.column("vector")
            ends = vectors.offsets.to_numpy()
            flat = pc.fill_null(vectors.values.cast(pa.float64()), float("nan")).to_numpy()
            fit = np.flatnonzero((np.diff(ends) == PARTS * width) & vectors.is_valid().to_numpy(zero_copy_only=False))
            v = flat[ends[fit][:, None] + np.arange(PARTS * width)]
            with np.errstate(over="ignore", invalid="ignore"):
                v = v * scale
                good = (np.abs(v) <= largest(width)).all(1)  # false for NaN and infinity
            v = np.floor(v[good]).astype(np.int64)
            if len(v):
                kept = rows.select(["vec_id", "label"]).take(pa.array(fit[good]))
                yield _state([common.packed(kept)], [_small(v).tobytes()], [b""])


def _small(v: np.ndarray) -> np.ndarray:
    return v.astype("<i2" if np.abs(v).max(initial=0) < 1 << 15 else "<i4" if np.abs(v).max() < 1 << 31 else "<i8")


def _state(rows: list, v: list, codes: list, part: list | None = None, entry: list | None = None, sums: list | None = None, radius: list | None = None) -> pa.RecordBatch:
    n, kinds = max(len(rows), len(part or [])), [pa.binary()] * 3 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c or [None] * n, k) for c, k in zip((rows, v, codes, part, entry, sums, radius), kinds, strict=True)], names=_NAMES)


def _read(batches: Iterator[pa.RecordBatch], parts: list[Balls]) -> Iterator[tuple[pa.RecordBatch, bytes, list[np.ndarray], list[np.ndarray], list[np.ndarray]]]:
    """Of every block: its rows, stored vectors, vectors by part, codes and squared distances by part."""
    width = parts[0].entries.shape[1]
    for batch in batches:
        for packed, stored, codes in zip(*(batch.column(c) for c in ("rows", "v", "codes")), strict=True):
            rows, raw = common.unpacked(packed.as_py()), stored.as_py()
            v = np.frombuffer(raw, f"<i{len(raw) // (rows.num_rows * PARTS * width)}").reshape(rows.num_rows, PARTS, width).astype(np.int64)
            before = np.frombuffer(codes.as_py(), np.uint8).reshape(PARTS, -1).astype(np.int64) if len(codes.as_py()) else [None] * PARTS
            found = [assigned(v[:, p], before[p], parts[p]) for p in range(PARTS)]
            yield rows, raw, [v[:, p] for p in range(PARTS)], [f[0] for f in found], [f[1] for f in found]


def _round(batches: Iterator[pa.RecordBatch], parts: list[Balls]) -> Iterator[pa.RecordBatch]:
    """Blocks with new codes; at the end of the task, sums, count (behind the sums) and squared radius of each entry that it used."""
    k, width = parts[0].entries.shape
    sums, radius = np.zeros((PARTS, k, width + 1), np.int64), np.full((PARTS, k), -1, np.int64)
    for rows, raw, v, codes, best in _read(batches, parts):
        for p in range(PARTS):
            order = np.argsort(codes[p], kind="stable")
            used, starts = np.unique(codes[p][order], return_index=True)
            sums[p, used, :width] += np.add.reduceat(v[p][order], starts, axis=0)
            sums[p, used, width] += np.diff(np.append(starts, len(order)))
            radius[p, used] = np.maximum(radius[p, used], np.maximum.reduceat(best[p][order], starts))
        yield _state([common.packed(rows)], [raw], [np.stack(codes).astype(np.uint8).tobytes()])
    p, e = np.nonzero(radius >= 0)
    if len(p):
        yield _state([], [], [], p.tolist(), e.tolist(), sums[p, e].tolist(), radius[p, e].tolist())


def _coded(batches: Iterator[pa.RecordBatch], parts: list[Balls]) -> Iterator[pa.RecordBatch]:
    for rows, _, _, codes, best in _read(batches, parts):
        text = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
        found = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
        yield common.with_columns(rows, code=pa.array(found, pa.string()), error=pa.array(sum(best), pa.int64()))


def _learned(state: DataFrame, books: list[np.ndarray]) -> list[Balls]:
    """The next entries, each the floored mean of its parts, and their balls: a ball's members were within its radius of the old entry, so they are
    within that and the way that the entry moved of the new one. What reaches the driver is a row per component of the codebooks."""
    k, width = books[0].shape
    found = state.where("part is not null").select("part", "entry", "radius", F.posexplode("sums").alias("i", "x"))
    total, radius = np.zeros((PARTS, k, width + 1), np.int64), np.full((PARTS, k), -1, np.int64)
    for p, e, i, x, r in found.groupBy("part", "entry", "i").agg(F.sum("x"), F.max("radius")).collect():
        total[p, e, i], radius[p, e] = x, r
    out = []
    for p, old in enumerate(books):
        used = total[p, :, width] > 0
        new = old.copy()
        new[used] = total[p, used, :width] // total[p, used, width:]
        moved = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64))
        reach = (np.sqrt(np.maximum(radius[p], 0).astype(np.float64)) + moved) ** 2 * (1 + 1e-9) + 1
        out.append(balls(new, np.where(used, np.ceil(reach), -1)))
    return out


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of every usable row, and the codebooks.

    Components x become floor(scale * x), vectors PARTS equal parts. A part's codebook starts as that part of the vectors of the `entries` (at most 256) smallest ids, ties by
    the vector, null ids last. In each of `rounds` rounds every part goes to the nearest entry (ties to the lower index), then entries become their parts' floored
    mean; entries without parts stay. At the end parts are assigned again: code has two hexadecimal digits a part, error the squared distances' sum,
    label_error the errors' sum over equal labels, nulls together. All of this is exact.

    Rows take no part whose vector is null or has null or non-finite components, nor those with more or fewer components than the first usable vector by id whose number of components is a multiple of
    PARTS, nor those with components so large that squared distances don't fit a long (see largest). Repeated rows and ids are rows of their own. Without usable rows there are no
    rows and no entries. Other columns don't take part. A round reads the table that the round before wrote, and drops it; nothing is shuffled but the sums of each task.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: entries must be between 1 and 256")
    spark, v = vectors.sparkSession, F.col("vector")
    rows = vectors.select(common.column(vec_id).alias("vec_id"), common.column(label).alias("label"), common.column(vector).alias("vector"))
    high = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")) * scale))
    fit = rows.where(usable(v) & (F.size(v) > 0) & (F.size(v) % PARTS == 0)).where(high <= largest(F.size(v) / PARTS))
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    head = fit.orderBy(*order).select("vector").first()
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if head is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("label_error", T.LongType())])), Codebooks([])
    width = len(head[0]) // PARTS
    first = fit.where(F.size(v) == PARTS * width).orderBy(*order).limit(entries).select("vector").collect()
    first = np.floor(np.array([r[0] for r in first], np.float64) * scale).astype(np.int64).reshape(-1, PARTS, width)
    parts = [Balls(np.ascontiguousarray(first[:, p])) for p in range(PARTS)]
    last = common.kept(rows.mapInArrow(partial(_cut, width=width, scale=scale), _STATE), "vectors")
    for _ in range(rounds):
        blocks = spark.read.schema(_STATE).parquet(last).where("part is null")
        path = common.kept(blocks.mapInArrow(partial(_round, parts=parts), _STATE), "vectors")
        common.drop(spark, last)
        parts, last = _learned(spark.read.schema(_STATE).parquet(path), [b.entries for b in parts]), path
    blocks = spark.read.schema(_STATE).parquet(last).where("part is null")
    coded = common.stored(blocks.mapInArrow(partial(_coded, parts=parts), schema), "codes")
    common.drop(spark, last)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), Codebooks([b.entries for b in parts])


def op12_vectorcodes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    coded, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_sql() -> str:
    """The same with all entries as candidates of every part; components and squared distances are whole numbers that doubles hold exactly."""
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(f"""a{t} as materialized (select r, p, any_value(x) as x, min({{'d': xx - 2 * list_dot_product(x, c) + cc, 'e': e}}) as best
  from parts join (select p, e, c, list_dot_product(c, c) as cc from b{t}) using (p) group by r, p)""")
        if t < ROUNDS:
            steps.append(f"""m{t} as (select p, best.e as e, i, floor(sum(x[i]) / count(*)) as y from a{t}, (select unnest(range(1, len(x) + 1)) as i from parts limit (select max(len(x)) from parts)) group by all),
b{t + 1} as materialized (select p, e, coalesce(y, c) as c from b{t} left join (select p, e, list(y order by i) as y from m{t} group by all) using (p, e))""")
    return f"""with v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select *, list_dot_product(x, x) as xx from (
  select r, vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as x from v, (select unnest(range({PARTS})) as p))),
b0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from parts qualify e < {ENTRIES}),
{", ".join(steps)},
coded as (select r, string_agg(lower(printf('%02x', best.e)), '' order by p) as code, cast(sum(best.d) as bigint) as error from a{ROUNDS} group by r),
books as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by p, e, i)) as codebooks_sha256
  from (select p, e, unnest(c) as y, generate_subscripts(c, 1) as i from b{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join v using (r), books"""
