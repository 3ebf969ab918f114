"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentloom.llm import common

#: Queries in a block, candidates in a block, bins of a histogram, blocks of histograms a task holds at once.
QUERY_BLOCK, ROW_BLOCK, BINS, HELD = 256, 2048, 1024, 16
#: Query blocks are broadcast up to so many bytes, and joined with ranges of RANGE blocks of candidates beyond.
BROADCAST_BYTES, RANGE = 4_000_000, 16


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def _rows(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A matrix of ragged rows; shorter ones end in zeros."""
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (vec_id, v) -> one row per block: ids, matrix (as binary), width."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(at, ROW_BLOCK)
            v = part.column("v")
            m = _rows(v.values.to_numpy(), v.offsets.to_numpy())
            ids = part.column("vec_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<i8").tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["ids", "matrix", "width"]
            )


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of all rows: in doubles where every partial sum stays below 2**53, else in 64-bit integers."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if not d:
        return np.zeros((len(q), len(c)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * d < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _met(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Per row, a block of queries met with one of candidates: block, query columns, candidates' ids, scores with
    the query's own row marked by False in a mask."""
    for r in range(batch.num_rows):
        qs = batch.column("queries")[r].values
        v = qs.field("v")
        q = _rows(v.values.to_numpy(), v.offsets.to_numpy())
        columns = {n: qs.field(n).to_numpy(zero_copy_only=False) for n in ("query", "query_id", "low", "step")}
        width = batch.column("width")[r].as_py()
        ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
        c = np.frombuffer(batch.column("matrix")[r].as_buffer(), "<i8").reshape(len(ids), width)
        yield batch.column("block")[r].as_py(), columns, ids, _scores(q, c), columns["query_id"][:, None] != ids


def _histograms(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, bin, n): counts of scores per bin from `low` in steps of `step`, bin BINS for all above.

    One task adds up its blocks; of each query it sends the bins down to where its own counts
    reach k, as the k-th score of all rows is no lower than that of some.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for ids, counts in held.values():
            above = counts[:, ::-1].cumsum(1)[:, ::-1]
            query, where = np.nonzero((counts > 0) & (above - counts < k))
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(where.astype(np.int32)), pa.array(counts[query, where])], names=["query", "bin", "n"])
        held.clear()

    for batch in batches:
        for block, q, _, s, other in _met(batch):
            if block not in held:
                if len(held) == HELD:
                    yield from sent()
                held[block] = (q["query"], np.zeros((len(s), BINS + 1), np.int64))
            counts = held[block][1]
            bins = np.clip((s - q["low"][:, None]) // q["step"][:, None], -1, BINS)
            flat = (bins + np.arange(len(s))[:, None] * (BINS + 1))[other & (bins >= 0)]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
    yield from sent()


def _found(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query, query_id, vec_id, score) of scores from `low` on, the best k of each block of candidates."""
    for batch in batches:
        for _, q, ids, s, other in _met(batch):
            query, row = np.nonzero(other & (s >= q["low"][:, None]))
            score, vec = s[query, row], ids[row]
            order = np.lexsort((vec, -score, query))
            query, score, vec = query[order], score[order], vec[order]
            place = np.arange(len(query)) - np.searchsorted(query, query, "left")
            best = place < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(q["query"][query[best]]), pa.array(q["query_id"][query[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query", "query_id", "vec_id", "score"]
            )


def search(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """The k rows (vec_id, v) with the highest integer inner product for each query (query_id, v): query_id, rank, vec_id, score.

    v are arrays of longs. Ties go to the smaller vec_id. Rows that carry the query's own id are no candidates of
    it; null ids or vectors take no part; a query with fewer candidates gets all, one without any gets no row.
    Repeated candidate rows count each. Query rows that repeat an id are queries of their own: each has its k rows. Shorter vectors count as ending in zeros. Scores must fit
    63 bits; Spark's arithmetic error tells if their bound does not. More than 30 rounds, which halve 63 bits away ten at a time, are an error.

    Scores are never stored. A query's k-th highest score lies in an interval that starts at
    the bound of the products' sizes; every round scores all rows anew, adds up a histogram of each query's interval over all tasks and keeps the
    bin that holds the k-th, until the interval is one value or few rows are left from it on. A last
    round returns the rows from there on, of which the first k by score and id remain.
    """
    rows = rows.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    queries = queries.where("query_id is not null and v is not null").select(F.monotonically_increasing_id().alias("query"), F.col("query_id").cast("long").alias("query_id"), "v")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    most, total = rows.agg(F.max(size), F.count("*")).first()
    n, width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = common.partitions_for(n or 0, QUERY_BLOCK)
    reach = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.abs(x)) * F.lit(int(most or 0)) + 1
    state = queries.select("query", "query_id", "v", (-reach).alias("low"), reach.alias("high"), F.lit(False).alias("done"))
    state = common.stored(state, "queries")
    chunks = rows.mapInArrow(_row_blocks, "ids binary, matrix binary, width int")
    small = (n or 0) * (width or 0) * 8 <= BROADCAST_BYTES
    ranges = common.partitions_for(-(-(total or 0) // ROW_BLOCK), RANGE)
    step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low")) / BINS)).cast("long")

    def met(queries: DataFrame) -> DataFrame:
        """Blocks of queries with blocks of candidates: broadcast where they are small, else joined by block and range of candidates, so
        that a task has one block of queries and RANGE or so of candidates at a time."""
        one = F.struct("query", "query_id", "v", "low", step.alias("step"))
        block = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(one).alias("queries"))
        dealt = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        if small:
            return dealt.join(F.broadcast(block), "block")
        block = block.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))))
        return dealt.withColumn("range", F.pmod(F.xxhash64("ids"), F.lit(ranges))).join(block.hint("merge"), ["block", "range"])

    for _ in range(30):
        open_ = state.where("not done")
        if not open_.head(1):
            break
        counts = met(open_).mapInArrow(partial(_histograms, k=k), "query long, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        upward = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # Scores above the interval fall into bin BINS; their number was known.
        at = counts.withColumn("to", upward).where(F.col("to") >= k).groupBy("query").agg(F.max("bin").alias("bin"), F.min_by("to", F.struct(-F.col("bin"))).alias("to"))
        new_low = F.col("low") + F.col("bin") * step
        settled = (step == 1) | (F.col("to") <= 4 * k)
        state = common.stored(
            state.join(at, "query", "left").select(
                "query", "query_id", "v",
                F.when(F.col("done"), F.col("low")).when(F.col("bin").isNull(), F.col("low")).otherwise(new_low).alias("low"),
                F.when(F.col("done") | F.col("bin").isNull(), F.col("high")).otherwise(new_low + step).alias("high"),
                (F.col("done") | F.col("bin").isNull() | settled).alias("done"),
            ), "queries",
        )
    else:
        raise RuntimeError("the intervals did not close")
    best = met(state).mapInArrow(partial(_found, k=k), "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every 100th one by integer inner product."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding")).alias("v"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return search(queries, rows, 10)


OP6_SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 10"""
